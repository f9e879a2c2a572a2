"""Hard negatives by dual-tree search: a tree over anchors, a tree over candidates, and bounds of inner products between their nodes.

Both trees share their upper levels: splits at medians along main axes, fitted on a bounded sample of rows, cut the space into at most 2 ** DEPTH
cells. Below them candidates stand in blocks of at most BLOCK rows of one cell, anchors in groups of at most GROUP anchors
of one label, both made by a range-partitioned sort, so a hot cell, label or vector spreads over many of them. Every node has a centre and
a radius: with centres a, b and radii r, s all inner products between two nodes lie within a.b +- (r|b| + s|a| + rs).

The search runs twice, for positives and then for the negatives in each positive's window of scores. An anchor's k-th best score among
the sampled rows bounds its k-th best among all from below. Pairs of nodes whose interval lies under every such bound, or over every window, are
dropped: first cells against cells from the root down (all groups of a cell at once), then groups against cells, then groups against
blocks. What is left is scored exactly, in tasks of up to SHARD neighbouring blocks and BATCH groups: integers in a floating type that
holds them exactly, Python integers beyond 2 ** 53. Each task returns the best of each anchor; the best of these are the result.

Cells are the only part of the trees that the driver and all tasks hold, with the sample; both are bounded whatever the number of rows.

Rows: null labels, null vectors and vectors with a null or non-finite component take no part. Ties go to the smaller id, null ids last; a null
id is no anchor. Repeated rows count each, as candidates and as anchors; rows with the anchor's own id are never its positives. Vectors
of different lengths meet as if zeros followed the shorter; an empty vector scores 0. Scores must fit a long. Anchors without
a positive, and positives without a negative in their window (all with a score below 0), return no row. Other columns are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.storage import materialize

ANCHOR_EVERY, RELABEL_EVERY, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows that the upper levels are fitted on and the first bounds are taken from; levels of splits.
SAMPLE, DEPTH = 8192, 6
#: Rows of a block, anchors of a group, blocks of a shard, groups of a batch: what a scoring task holds at once.
BLOCK, GROUP, SHARD, BATCH = 1024, 64, 64, 4096
NOTHING, EVERYTHING = -(2**63), 2**63 - 1
#: Bits of the sampling hash.
HASHED = 1 << 20


# ---- vectors as bytes ----


def narrow(matrix: np.ndarray) -> np.ndarray:
    """The same integers in the least type that holds them."""
    low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    return matrix.astype(next(kind for kind in (np.int16, np.int32, np.int64) if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max))


def widened(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices under each other, zeros to the right of the shorter rows."""
    width = max((p.shape[1] for p in parts), default=0)
    return np.concatenate([p if p.shape[1] == width else np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]) if parts else np.zeros((0, 0), np.int64)


def read_vectors(column: pa.ChunkedArray, sizes: pa.ChunkedArray) -> np.ndarray:
    """A matrix from one vector a row; sizes: bytes of each component."""
    data, size = column.to_pylist(), sizes.to_pylist()
    if len({(len(x), s) for x, s in zip(data, size)}) == 1:
        return np.frombuffer(b"".join(data), dtype=f"<i{size[0]}").reshape(len(data), -1).astype(np.int64)
    return widened([np.frombuffer(x, dtype=f"<i{s}").reshape(1, -1).astype(np.int64) for x, s in zip(data, size)])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exactly."""
    width = max(a.shape[1], b.shape[1])
    a, b = (m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    largest = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    bound = largest(a) * largest(b) * max(width, 1)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by id, null ids last."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], no_id[at], -scores[at]))[:k]]


# ---- upper levels ----


@dataclass
class Cells:
    """Splits of the space, the cells they end in, and the sampled rows."""

    axes: list[np.ndarray | None] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    centres: dict[int, np.ndarray] = field(default_factory=dict)
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))

    def fit(self, rows: np.ndarray, depth: int) -> int:
        """A node over the sampled rows and those below it; the number of the node."""
        node = len(self.axes)
        self.axes.append(None)
        self.cuts.append(0.0)
        self.children.append((-1, -1))
        self.centres[node] = rows.mean(0)
        spread = rows - self.centres[node]
        if depth and len(rows) >= 64 and spread.any():
            axis = spread[np.argmax((spread**2).sum(1))]
            for _ in range(8):  # towards the main axis
                axis = spread.T @ (spread @ axis)
                axis = axis / max(float(np.linalg.norm(axis)), 1e-300)
            at = spread @ axis
            cut = float(np.median(at))
            left = at <= cut
            if left.any() and not left.all():
                self.axes[node], self.cuts[node] = axis, cut
                self.children[node] = (self.fit(rows[left], depth - 1), self.fit(rows[~left], depth - 1))
        return node

    def fitted_width(self, vectors: np.ndarray) -> np.ndarray:
        width = self.vectors.shape[1]
        return (vectors[:, :width] if vectors.shape[1] >= width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))).astype(np.float64)

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its place along the cell's last split."""
        rows = self.fitted_width(vectors)
        cell, along = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, at = waiting.pop()
            if self.axes[node] is None or not len(at):
                cell[at] = node
                continue
            along[at] = (rows[at] - self.centres[node]) @ self.axes[node]
            left = along[at] <= self.cuts[node]
            waiting += [(self.children[node][0], at[left]), (self.children[node][1], at[~left])]
        return cell, along

    def reach(self, cell: int, vectors: np.ndarray) -> float:
        """The largest distance of rows from a cell's centre."""
        centre = np.pad(self.centres[cell], (0, max(0, vectors.shape[1] - len(self.centres[cell]))))
        rows = vectors.astype(np.float64) if vectors.shape[1] >= len(centre) else np.pad(vectors.astype(np.float64), ((0, 0), (0, len(centre) - vectors.shape[1])))
        return radius(rows - centre)

    def nodes(self, reaches: dict[int, float]) -> dict[int, float]:
        """The radius of every node that has rows below it, from those of its cells."""
        found: dict[int, float] = {}
        for node in range(len(self.axes) - 1, -1, -1):
            below = [c for c in self.children[node] if c in found]
            if node in reaches:
                found[node] = reaches[node]
            elif below:
                found[node] = max(float(np.linalg.norm(self.centres[node] - self.centres[c])) + found[c] for c in below)
        return found


def radius(spread: np.ndarray) -> float:
    """The largest length of the rows, a little rounded up."""
    return float(np.sqrt((spread**2).sum(1).max())) * (1 + 1e-9) + 1e-6 if len(spread) else 0.0


def interval(a: np.ndarray, r: float, b: np.ndarray, s: float) -> tuple[float, float]:
    """Bounds of the inner products between two nodes."""
    middle = float(a @ b)
    norms = float(np.linalg.norm(a)), float(np.linalg.norm(b))
    reach = (r * norms[1] + s * norms[0] + r * s) * (1 + 1e-9) + 1e-9 * abs(middle) + 1e-3
    return middle - reach, middle + reach


def sampled(rows: DataFrame) -> Cells:
    """The upper levels over a sample of about SAMPLE rows, at most twice as many."""
    n = rows.count()
    share = min(HASHED, -(-SAMPLE * HASHED // max(n, 1)))
    found = rows.where(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(HASHED)) < share).limit(2 * SAMPLE).toArrow()
    cells = Cells()
    if not len(found):  # few rows, none of them in the sample
        found = rows.limit(SAMPLE).toArrow()
    if not len(found):
        return cells
    cells.vectors = _lists(found["vector"].combine_chunks())
    cells.ids, cells.labels = found["id"].fill_null(EVERYTHING).to_numpy(), found["label"].to_numpy()
    cells.fit(cells.vectors.astype(np.float64), DEPTH)
    return cells


def _lists(column: pa.Array) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(set(sizes.tolist())) <= 1:
        return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)
    return widened([x.reshape(1, -1) for x in np.split(flat, np.cumsum(sizes)[:-1])])


# ---- lower levels ----


def _routed(rows: DataFrame, cells: Cells) -> DataFrame:
    """id, label, cell, along, size and vector (bytes) of each row."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _lists(batch.column(2))
            cell, along = cells.of(vectors)
            small = narrow(vectors)
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            data = [row[:length].tobytes() for row, length in zip(small, lengths)]
            arrays = [batch.column(0), batch.column(1), pa.array(cell), pa.array(along), pa.array([small.itemsize] * len(data)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "cell", "along", "size", "data"])

    return rows.select("id", "label", "vector").mapInArrow(route, "id long, label long, cell long, along double, size long, data binary")


def _runs(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Neighbouring rows of one value of `key`, at most so many at once."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        values = waiting[key].to_numpy()
        ends = [*(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()]
        begin = 0
        for end in [*ends, len(values)]:
            while end - begin >= most or (end < len(values) and begin < end):
                stop = min(begin + most, end)
                yield waiting.slice(begin, stop - begin)
                begin = stop
        waiting = waiting.slice(begin)
    if waiting is not None and waiting.num_rows:
        yield waiting


def _node(run: pa.Table) -> tuple[np.ndarray, np.ndarray, float, dict]:
    """A run's vectors, centre, radius and what a scoring task needs of it."""
    vectors = read_vectors(run["data"], run["size"])
    centre = vectors.mean(0)
    small = narrow(vectors)
    ids = run["id"]
    return vectors, centre, radius(vectors - centre), {
        "n": run.num_rows,
        "size": small.itemsize,
        "data": small.tobytes(),
        "ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
        "no_id": np.array(ids.is_null().to_pylist(), dtype=np.uint8).tobytes(),
    }


PAYLOAD = "n long, size long, data binary, ids binary, no_id binary"
NODE = f"cell long, reach double, centre array<double>, radius double, {PAYLOAD}"


def _rows_of(found: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    fields = [x.strip().split(" ", 1) for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([found[name]], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def blocks_of(rows: DataFrame, cells: Cells) -> DataFrame:
    """The candidates' tree below the cells: a row a block, with the labels in it, and its shard."""
    schema = f"{NODE}, labels array<long>, row_labels binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "cell", BLOCK):
            vectors, centre, r, payload = _node(run)
            cell, labels = run["cell"][0].as_py(), run["label"].to_numpy()
            node = {"cell": cell, "reach": cells.reach(cell, vectors), "centre": centre, "radius": r}
            yield _rows_of(node | payload | {"labels": np.unique(labels), "row_labels": labels.astype("<i8").tobytes()}, schema)

    # equal rows are told apart by their places, so that many of them don't stay in one partition
    routed = _routed(rows, cells).withColumn("row", F.monotonically_increasing_id())
    order = ["cell", "label", "along", "id", "row"]
    built = routed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(build, schema)
    built = built.withColumn("block", F.monotonically_increasing_id())
    part = F.shiftleft(F.shiftright("block", 33), 33)
    return materialize(built.withColumn("shard", part + F.floor((F.col("block") - part) / SHARD)), "blocks")


def groups_of(rows: DataFrame, cells: Cells) -> DataFrame:
    """The anchors' tree below the cells: a row a group, with its label."""
    schema = f"label long, {NODE}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "label", GROUP):
            vectors, centre, r, payload = _node(run)
            cell = run["cell"][run.num_rows // 2].as_py()
            node = {"label": run["label"][0].as_py(), "cell": cell, "reach": cells.reach(cell, vectors), "centre": centre, "radius": r}
            yield _rows_of(node | payload, schema)

    routed = _routed(rows, cells).withColumn("row", F.monotonically_increasing_id())
    order = ["label", "cell", "along", "id", "row"]
    built = routed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(build, schema)
    return materialize(built.withColumn("group", F.monotonically_increasing_id()), "groups")


# ---- search ----


def _wanted(groups: DataFrame, cells: Cells, k: int) -> DataFrame:
    """group, anchor (its place in the group), wish, floor and top: the scores that the k best of each wish lie in.

    groups: with wishes, an array of (anchor, wish, low, high, same): the scores asked for, of rows of the same label or of others. floor is the
    k-th best of them in the sample.
    """
    schema = "group long, floors array<long>, low long, high long"

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors = np.frombuffer(row["data"], dtype=f"<i{row['size']}").reshape(row["n"], -1).astype(np.int64)
                ids = np.frombuffer(row["ids"], dtype="<i8")
                scores = products(anchors, cells.vectors)
                same = cells.labels == row["label"]
                floors = []
                for wish in row["wishes"]:
                    at = scores[wish["anchor"]]
                    fits = (same & (cells.ids != ids[wish["anchor"]]) if wish["same"] else ~same) & (at >= wish["low"]) & (at <= wish["high"])
                    found = at[fits]
                    floors.append(int(np.partition(found, len(found) - k)[len(found) - k]) if len(found) >= k else wish["low"])
                high = max((w["high"] for w in row["wishes"]), default=NOTHING)
                yield _rows_of({"group": row["group"], "floors": floors, "low": min(floors, default=EVERYTHING), "high": high}, schema)

    return groups.select("group", "label", "n", "size", "data", "ids", "wishes").mapInArrow(bound, schema)


def _pairs_of_cells(cells: Cells, anchors: list, candidates: list) -> dict[int, list[int]]:
    """For each cell with groups, the cells whose interval meets a wish: both trees descended from their roots together."""
    bounds = {r["cell"]: (r["low"], r["high"]) for r in anchors}
    of_anchors, of_candidates = (cells.nodes({r["cell"]: r["reach"] for r in side}) for side in (anchors, candidates))
    low, high = {}, {}
    for node in sorted(of_anchors, reverse=True):  # children have larger numbers
        below = [bounds[node]] if node in bounds else []
        below += [(low[c], high[c]) for c in cells.children[node] if c in low]
        low[node], high[node] = min(x[0] for x in below), max(x[1] for x in below)
    found: dict[int, list[int]] = {}
    waiting = [(0, 0)]
    while waiting:
        a, b = waiting.pop()
        if a not in of_anchors or b not in of_candidates:
            continue
        least, most = interval(cells.centres[a], of_anchors[a], cells.centres[b], of_candidates[b])
        if most < low[a] or least > high[a]:
            continue
        leaves = cells.axes[a] is None, cells.axes[b] is None
        if all(leaves):
            found.setdefault(a, []).append(b)
        elif leaves[1] or (not leaves[0] and of_anchors[a] >= of_candidates[b]):
            waiting += [(c, b) for c in cells.children[a]]
        else:
            waiting += [(a, c) for c in cells.children[b]]
    return found


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def _pairs(groups: DataFrame, blocks: DataFrame, cells: Cells, same: bool) -> DataFrame:
    """group, block and shard of the pairs of nodes that are left to score; groups: with low and high."""
    spans = groups.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("reach").alias("reach")).collect()  # a row a cell
    reaches = blocks.groupBy("cell").agg(F.max("reach").alias("reach")).collect()
    of_cells = _pairs_of_cells(cells, spans, reaches)
    reach = {r["cell"]: r["reach"] for r in reaches}

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_group, found_cell = [], []
            for row in batch.to_pylist():
                centre = cells.fitted_width(np.array(row["centre"], dtype=np.float64).reshape(1, -1))[0]
                outside = np.array(row["centre"], dtype=np.float64)[len(centre) :]
                for cell in of_cells.get(row["cell"], []):
                    # components that the sample hadn't are in the radius
                    least, most = interval(centre, row["radius"] + float(np.linalg.norm(outside)), cells.centres[cell], reach[cell])
                    if most >= row["low"] and least <= row["high"]:
                        found_group.append(row["group"])
                        found_cell.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(found_group, pa.int64()), pa.array(found_cell, pa.int64())], names=["group", "b_cell"])

    nodes = groups.select("group", "cell", "centre", "radius", "low", "high")
    met = nodes.mapInArrow(descend, "group long, b_cell long").join(groups.select("group", "label", "centre", "radius", "low", "high"), "group")
    other = blocks.select(F.col("cell").alias("b_cell"), "block", "shard", F.col("centre").alias("b_centre"), F.col("radius").alias("b_radius"), "labels")
    norm = lambda x: F.sqrt(_dot(x, x))
    reached = (F.col("radius") * norm("b_centre") + F.col("b_radius") * norm("centre") + F.col("radius") * F.col("b_radius")) * (1 + 1e-9) + F.abs("middle") * 1e-9 + 1e-3
    label = F.array_contains("labels", F.col("label")) if same else (F.size("labels") > 1) | (F.col("labels")[0] != F.col("label"))
    pairs = met.join(other, "b_cell").where(label).withColumn("middle", _dot("centre", "b_centre")).withColumn("reached", reached)
    return pairs.where((F.col("middle") + F.col("reached") >= F.col("low")) & (F.col("middle") - F.col("reached") <= F.col("high"))).select("group", "block", "shard")


FOUND = "group long, anchor long, wish long, anchor_id long, id long, score long"


def _score(blocks: pa.Table, asks: pa.Table, k: int, same: bool) -> pa.Table:
    """The k best of each wish among the blocks that its group asks for."""
    at, parts, begin = {}, [], 0
    for b in blocks.to_pylist():
        vectors = np.frombuffer(b["data"], dtype=f"<i{b['size']}").reshape(b["n"], -1)
        at[b["block"]] = np.arange(begin, begin + b["n"])
        begin += b["n"]
        parts.append((vectors, np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["no_id"], np.uint8), np.frombuffer(b["row_labels"], "<i8")))
    out: list[tuple] = []
    if parts:
        all_vectors, all_ids, all_no_id, all_labels = widened([p[0] for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        for ask in asks.to_pylist():
            anchors = np.frombuffer(ask["data"], dtype=f"<i{ask['size']}").reshape(ask["n"], -1)
            own = np.frombuffer(ask["ids"], "<i8")
            rows = np.concatenate([at[b] for b in ask["blocks"]])
            rows = rows[(all_labels[rows] == ask["label"]) == same]
            scores = products(anchors, all_vectors[rows])
            ids, no_id = all_ids[rows], all_no_id[rows]
            for wish, floor in zip(ask["wishes"], ask["floors"]):
                of_anchor = scores[wish["anchor"]]
                fits = (of_anchor >= floor) & (of_anchor <= wish["high"])
                if same:
                    fits &= (ids != own[wish["anchor"]]) | (no_id == 1)
                fits = np.flatnonzero(fits)
                for i in fits[best(of_anchor[fits], ids[fits], no_id[fits], k)]:
                    out.append((ask["group"], wish["anchor"], wish["wish"], int(own[wish["anchor"]]), None if no_id[i] else int(ids[i]), int(of_anchor[i])))
    columns = list(zip(*out)) if out else [[]] * 6
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["group", "anchor", "wish", "anchor_id", "id", "score"])


def search(groups: DataFrame, blocks: DataFrame, cells: Cells, k: int, same: bool, name: str) -> DataFrame:
    """group, anchor, wish, anchor_id, id, score and rank: the k best of each wish; groups: with wishes as for _wanted."""
    groups = materialize(groups.join(_wanted(groups, cells, k), "group"), f"{name}-wishes")
    pairs = materialize(_pairs(groups, blocks, cells, same).groupBy("group", "shard").agg(F.collect_list("block").alias("blocks")), f"{name}-pairs")
    batches = -(-max(groups.count(), 1) // BATCH)
    pairs = pairs.withColumn("batch", F.pmod(F.xxhash64("group"), F.lit(batches)))
    asks = pairs.join(groups.select("group", "label", "n", "size", "data", "ids", "wishes", "floors"), "group")
    met = pairs.select("shard", "batch").distinct().select(*[F.col(x).alias(f"a_{x}") for x in ("shard", "batch")])
    payload = ["block", *[x.split()[0] for x in PAYLOAD.split(", ")], "row_labels"]
    asked = blocks.join(met, F.col("shard") == F.col("a_shard")).select("a_shard", "a_batch", *payload)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, k, same)

    found = asked.groupBy("a_shard", "a_batch").cogroup(asks.groupBy("shard", "batch")).applyInArrow(score, FOUND)
    order = Window.partitionBy("group", "anchor", "wish").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    rows: id (long), label (long), vector (array<long>), anchor (boolean), no nulls but in id. A negative's score s fits a positive's
    score p if low * p <= 100 * s <= high * p.
    """
    cells = sampled(rows)
    if not len(cells.axes):
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks, groups = blocks_of(rows, cells), groups_of(rows.where("anchor"), cells)
    wish = lambda anchor, number, least, most, same: F.struct(anchor.cast("long").alias("anchor"), number.cast("long").alias("wish"), least.alias("low"), most.alias("high"), F.lit(same).alias("same"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: wish(i, F.lit(0), F.lit(NOTHING), F.lit(EVERYTHING), True))
    first = materialize(search(groups.withColumn("wishes", every), blocks, cells, positives, True, "positives"), "positives")
    # shares of a score in whole numbers, up and down, by parts that can't overflow
    percent = lambda share, up: F.expr(f"{share} * (score div 100) + ({share} * (score % 100) + {up}) div 100")
    window = wish(F.col("anchor"), F.col("rank"), percent(low, 99), percent(high, 0), False)
    wishes = first.where("score >= 0").groupBy("group").agg(F.collect_list(window).alias("wishes"))
    second = search(groups.join(wishes, "group"), blocks, cells, negatives, False, "negatives")
    of_positive = first.select("group", "anchor", F.col("rank").cast("long").alias("wish"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return second.join(of_positive, ["group", "anchor", "wish"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def labelled_vectors(embeddings: DataFrame, every: int = ANCHOR_EVERY, relabel: int = RELABEL_EVERY, labels: int = LABELS, scale: int = SCALE) -> DataFrame:
    """The rows of `embeddings` that take part, as hard_negatives() reads them: components in whole steps of 1 / scale."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ids = F.col("vec_id").cast("long")
    label = F.when(ids % relabel == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    taking_part = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    return taking_part.select(ids.alias("id"), label.alias("label"), vector.alias("vector"), F.coalesce(ids % every == 0, F.lit(False)).alias("anchor"))
