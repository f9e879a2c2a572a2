"""Language-model scoring with a weighted backoff automaton.

Counts come from all training texts. Texts are turned into numbers chunk by chunk (a bounded stretch of one task's
input), each chunk with its own lexicon. Lexicons and n-grams meet those of other chunks in PARTS parts by hashes: a chunk sends each part one row, with
all its words or n-grams of that part, sorted and compressed, so a common word or n-gram is one entry a chunk and never a part of its own. What a part counts goes back to the
chunks in rows of the same form. So no table of all words is ever broadcast or held by one task, and an n-gram takes about three bytes of a shuffle.

The model interpolates, by absolute discounting, 3-grams and 2-grams with add-one 1-grams of all words:
p(w|h) = max(c(hw) - D, 0) / c(h) + weight(h) * p(w|shorter h), where n-grams that occur LEAST_COUNT times or more in all training texts are
kept, whatever the size of the corpus. Nothing of the model is broadcast. Words that may be in a kept n-gram get dense numbers, their names, and so do kept 2-grams; a 2-gram is known by the
names of its words, a 3-gram by those of its first 2-gram and its last word, both put through a bijection that spreads them evenly, so they are never mistaken for others. What is kept goes back to the chunks that have it, with
what follows each context in the whole corpus. There each kept context is a state, each kept n-gram an arc with its log-probability, and the
failure arc of a state bears its backoff weight and leads to its longest suffix. States and arcs are sorted arrays, and the state before
a word is told by the two words before it, so that all words of a chunk are traversed at once.

Probabilities of all words and one unknown word sum to one after any history. A text's score includes its end token.

Rows: one per input row, repeated rows too. Null text counts as empty: one token, the end. A null doc_id is a training row.
Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import text_or_empty
from evidentia.storage import materialize

FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES = 24 << 20
#: The least count of an n-gram, at every size of the corpus.
LEAST_COUNT = 3
DISCOUNT = 0.75
#: White space is never part of a word, so this one can stand for the end.
END = b"\n"
#: Parts in which lexicons and n-grams meet, a power of two; each holds as many of all.
PART_BITS = 11
PARTS = 1 << PART_BITS
CODEC = "zstd"
#: Places of a chunk that are worked on at once, and bytes of texts that are split at once.
BLOCK, SPLIT_BYTES = 1 << 19, 3 << 20


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(5, "little") + pa.compress(raw, CODEC, asbytes=True)


def _unsqueezed(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:5], "little")
    return pa.decompress(packed[5:], size, CODEC, asbytes=True) if size else b""


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 0 or more, compressed: first the lowest bytes of all, then the next ones."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + len(values).to_bytes(5, "little") + _squeezed(planes.T.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:6], "little")
    values = np.zeros((n, 8), np.uint8)
    if width and n:
        values[:, :width] = np.frombuffer(_unsqueezed(packed[6:]), np.uint8).reshape(width, n).T
    return values.view("<i8").reshape(n)


def _steps(values: np.ndarray) -> bytes:
    """Sorted numbers by the steps between them."""
    return _packed(np.diff(values, prepend=0))


def _climbed(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(packed))


def _joined(column: pa.ChunkedArray, read=_unpacked) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(read, column.to_pylist())])


#: Odd numbers of the bijection, and their inverses.
ODDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of so many bits whose high bits are even."""
    x, mask, half = keys.astype(np.uint64), np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for odd in ODDS:
        x = x * np.uint64(odd) & mask
        x ^= x >> half
    return x.astype(np.int64)


def _unmixed(mixed: np.ndarray, bits: int) -> np.ndarray:
    x, mask, half = mixed.astype(np.uint64), np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for odd in reversed(ODDS):
        x ^= x >> half
        x = x * np.uint64(pow(odd, -1, 1 << 64)) & mask
    return x.astype(np.int64)


def _bits(contexts: int, words: int) -> int:
    """Bits of an n-gram's number: context * words + word."""
    bits = max(2 * PART_BITS, (contexts * words).bit_length())
    if bits > 63:
        raise OverflowError(f"{contexts} contexts of {words} words need more than 63 bits")
    return bits


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in kinds.items()])


LONG, BINARY = T.LongType(), T.BinaryType()
#: What comes back from a part to a chunk, in compressed columns: its words (by their numbers in the chunk) or n-grams (by mixed numbers), their counts in training
#: texts and names + 1 (0: none). On rows without a chunk: a context, and the sum and number of the counts of what follows it. known: words with a count; most: the highest name + 1.
COUNTED = _fields(chunk=LONG, part=LONG, x=BINARY, c=BINARY, name=BINARY, a=LONG, total=LONG, kinds=LONG, known=LONG, most=LONG)
MODEL = _fields(chunk=LONG, part=LONG, x=BINARY, c=BINARY, name=BINARY, total=BINARY, kinds=BINARY)
GRAMS = _fields(chunk=LONG, part=LONG, x=BINARY, n=BINARY)


def _arrow(schema: T.StructType, **columns) -> pa.Table:
    """A table of this schema from lists or arrays; columns that aren't given are null."""
    m = len(next(iter(columns.values())))
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    return pa.table([pa.array(columns[f.name], kinds[f.dataType.simpleString()]) if f.name in columns else pa.nulls(m, kinds[f.dataType.simpleString()]) for f in schema], names=schema.names)


def _word_ids(texts: pa.Array, words: dict[bytes, int]) -> Iterator[np.ndarray]:
    """The numbers of each text's words and its end; new words get new numbers in `words`."""
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())  # a copy, for ascii_lower misreads slices
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    listed = coded.dictionary.cast(pa.large_binary()).to_pylist()
    number = np.array([words[x] if x else -1 for x in listed], np.int64)  # texts that begin or end with white space have an empty part there
    ids = number[coded.indices.to_numpy()]
    starts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(split).to_numpy(zero_copy_only=False))])
    for start, end in zip(starts[:-1], starts[1:]):
        own = ids[start:end]
        yield np.append(own[own >= 0], 0).astype("<u4")


def _numbered(id_type: T.DataType, chunk_bytes: int):
    """Rows of documents (ids within the chunk's lexicon) and rows of the lexicons, one a part: words, their numbers in the chunk, their counts in training texts and the sum of these."""
    schema = _fields(chunk=LONG, doc_id=id_type, held_out=T.BooleanType(), ids=BINARY, part=LONG, words=BINARY, local=BINARY, n=BINARY, tokens=LONG)
    types: list = [None, None]

    def lexicon(chunk: int, words: dict[bytes, int], train: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(np.concatenate(train), minlength=len(words)) if train else np.zeros(len(words), np.int64)
        listed = list(words)
        parts = np.array([zlib.crc32(x) % PARTS for x in listed])
        order = np.argsort(parts, kind="stable")
        some, starts = np.unique(parts[order], return_index=True)
        groups = np.split(order, starts[1:])
        m = len(groups)
        columns = [pa.array([chunk] * m, pa.int64()), pa.nulls(m, types[1]), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), pa.array(some, pa.int64())]
        columns += [pa.array([_squeezed(b" ".join([listed[i] for i in group])) for group in groups], pa.binary()), pa.array([_steps(group) for group in groups], pa.binary())]
        columns += [pa.array([_packed(counts[group]) for group in groups], pa.binary()), pa.array([int(counts[group].sum()) for group in groups], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k, size = TaskContext.get().partitionId() << 24, 0, 0
        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        words[END]  # noqa: B018  gets number 0
        train: list[np.ndarray] = []
        any_row = False
        for batch in batches:
            types[1] = batch.column(0).type
            held = batch.column(2).to_pylist()
            at = 0
            ends = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                start = at
                # up to and with the text that fills the chunk
                done = ends[start - 1] if start else 0
                at = min(batch.num_rows, int(np.searchsorted(ends, done + min(chunk_bytes - size, SPLIT_BYTES))) + 1)
                size += int(ends[at - 1] - done)
                numbered = []
                for k_text, ids in enumerate(_word_ids(batch.column(1).slice(start, at - start), words), start):
                    if not held[k_text]:
                        train.append(ids)
                    numbered.append(_packed(ids))
                m = at - start
                any_row = any_row or m > 0
                columns = [pa.array([base + k] * m, pa.int64()), batch.column(0).slice(start, m), batch.column(2).slice(start, m), pa.array(numbered, pa.binary())]
                columns += [pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.binary())] * 3, pa.nulls(m, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                if size >= chunk_bytes:
                    yield from lexicon(base + k, words, train)
                    words.clear()
                    words[END]  # noqa: B018
                    train, k, size, any_row = [], k + 1, 0, False
        if any_row:
            yield from lexicon(base + k, words, train)

    return number, schema


def _run(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all documents one after another, each followed by a gap of -1; the document and whether it is trained on, of each place."""
    texts = [np.append(_unpacked(x), -1).astype(np.int32) for x in docs["ids"].to_pylist()]
    sizes = np.array([len(x) for x in texts], np.int64)
    return np.concatenate(texts), np.repeat(np.arange(len(texts), dtype=np.int32), sizes), np.repeat(~docs["held_out"].to_numpy(), sizes)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of what is wanted in sorted keys, -1 for what isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _find_mixed(keys: np.ndarray, wanted: np.ndarray, bits: int) -> np.ndarray:
    """_find for mixed numbers (-1: none is wanted): keys are even, so their high bits tell nearly where each stands."""
    found = np.full(len(wanted), -1, np.int32)
    low = max(0, bits - len(keys).bit_length())
    starts = np.concatenate([[0], np.cumsum(np.bincount(keys >> low, minlength=1 << (bits - low)))])
    for begin in range(0, len(wanted), BLOCK):
        left = begin + np.flatnonzero(wanted[begin : begin + BLOCK] >= 0)
        slot = wanted[left] >> low
        at, end = starts[slot], starts[slot + 1]
        while len(left):
            inside = at < end
            left, at, end = left[inside], at[inside], end[inside]
            hit = keys[at] == wanted[left]
            found[left[hit]] = at[hit]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
    return found


def _key(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.int64) << 32 | low.astype(np.int64)


def _by_part(rows: DataFrame, work, schema: T.StructType) -> DataFrame:
    """What `work` makes of the rows of each part, sorted by chunk (so that names are the same whenever a task is repeated), one part after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        for batch in batches:
            parts = batch.column("part").to_numpy()
            starts = [0, *np.flatnonzero(np.diff(parts)) + 1] if len(parts) else []
            for start, end in zip(starts, [*starts[1:], len(parts)]):
                if own and own[-1].column("part")[0].as_py() != parts[start]:
                    yield from work(pa.Table.from_batches(own)).to_batches()
                    own = []
                own.append(batch.slice(start, end - start))
        if own:
            yield from work(pa.Table.from_batches(own)).to_batches()

    return rows.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(run, schema)


def _count_words(least: int):
    """Words of one part of all chunks' lexicons."""

    def count(rows: pa.Table) -> pa.Table:
        words = [_unsqueezed(x).split(b" ") for x in rows["words"].to_pylist()]
        coded = pa.array([w for some in words for w in some], pa.binary()).dictionary_encode()
        code, part = coded.indices.to_numpy(), rows["part"][0].as_py()
        counts = np.bincount(code, weights=_joined(rows["n"]), minlength=len(coded.dictionary)).astype(np.int64)
        often = counts >= least
        names = np.where(often, part + PARTS * (np.cumsum(often) - 1) + 1, 0)
        ends = np.cumsum([len(some) for some in words])[:-1]
        m = rows.num_rows
        known = [int((counts > 0).sum())] + [0] * (m - 1)
        some = {k: [_packed(x) for x in np.split(values[code], ends)] for k, values in (("c", counts), ("name", names))}
        return _arrow(COUNTED, chunk=rows["chunk"].to_pylist(), part=[part] * m, x=rows["local"].to_pylist(), **some, known=known, most=[int(names.max())] * m)

    return count


def _count_grams(least: int, bits: int, n_words: int):
    """N-grams of one part of all chunks; those that are kept go back to each chunk that has them."""

    def count(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        own = [_climbed(x) for x in rows["x"].to_pylist()]
        gram, place = np.unique(np.concatenate(own), return_inverse=True)
        counts = np.bincount(place, weights=_joined(rows["n"]), minlength=len(gram)).astype(np.int64)
        kept = counts >= least
        names = part + PARTS * (np.cumsum(kept) - 1) + 1
        found = []
        for chunk, at in zip(rows["chunk"].to_pylist(), np.split(place, np.cumsum([len(x) for x in own])[:-1])):
            at = at[kept[at]]
            if len(at):
                found.append((chunk, _steps(gram[at]), _packed(counts[at]), _steps(names[at])))
        chunk, x, c, name = zip(*found) if found else ((), (), (), ())
        back = _arrow(COUNTED, chunk=chunk, part=[part] * len(found), x=x, c=c, name=name, most=[int(names.max())] * len(found))
        context, place = np.unique(_unmixed(gram[kept], bits) // n_words, return_inverse=True)
        total, kinds = (np.bincount(place, weights=w, minlength=len(context)).astype(np.int64) for w in (counts[kept], None))
        return pa.concat_tables([back, _arrow(COUNTED, a=context, total=total, kinds=kinds)])

    return count


def _names(words: pa.Table) -> np.ndarray:
    """The names of a chunk's words by their numbers, -1 for words without one; the last is the gap's."""
    local, name = _joined(words["x"], _climbed), _joined(words["name"])
    names = np.full(int(local.max(initial=-1)) + 2, -1, np.int64)
    names[local] = name - 1
    return names


def _pairs(run: np.ndarray, names: np.ndarray, bits: int, n_words: int) -> np.ndarray:
    """The mixed number of the 2-gram that begins at each place; -1 where a word has no name."""
    pairs = np.full(len(run) - 1, -1, np.int64)
    for begin in range(0, len(pairs), BLOCK):
        named = names[run[begin : begin + BLOCK + 1]]
        open_ = (named[:-1] >= 0) & (named[1:] >= 0)
        pairs[begin : begin + BLOCK][open_] = _mixed(named[:-1][open_] * n_words + named[1:][open_], bits)
    return pairs


def _grams(chunk: int, mixed: np.ndarray, train: np.ndarray, bits: int) -> pa.Table:
    """A chunk's n-grams by parts: each once, with its count in training texts; held-out texts' own have count 0."""
    gram, place = np.unique(mixed, return_inverse=True)
    n = np.bincount(place, weights=train, minlength=len(gram)).astype(np.int64)
    parts, starts = np.unique(gram >> (bits - PART_BITS), return_index=True)
    split = lambda values: np.split(values, starts[1:]) if len(values) else []
    return _arrow(GRAMS, chunk=[chunk] * len(parts), part=parts, x=[*map(_steps, split(gram))], n=[*map(_packed, split(n))])


def _of(model: pa.Table, size: int) -> pa.Table:
    return model.filter(pa.compute.equal(model["size"], size)).sort_by("part")


def _twos(bits: int, n_words: int):
    """The 2-grams of the chunk's documents, of words that are frequent enough for any."""

    def grams(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return GRAMS_NONE
        run, _, train = _run(docs)
        pairs = _pairs(run, _names(words), bits, n_words)
        return _grams(docs["chunk"][0].as_py(), pairs[pairs >= 0], train[1:][pairs >= 0], bits)

    return grams


def _threes(bits: int, bits3: int, n_words: int):
    """The 3-grams of the chunk's documents whose two 2-grams are kept."""

    def grams(docs: pa.Table, model: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return GRAMS_NONE
        run, _, train = _run(docs)
        names, twos = _names(_of(model, 1)), _of(model, 2)
        pair = _find_mixed(_joined(twos["x"], _climbed), _pairs(run, names, bits, n_words), bits)
        at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        pair_names = _joined(twos["name"], _climbed) - 1
        return _grams(docs["chunk"][0].as_py(), _mixed(pair_names[pair[at]] * n_words + names[run[at + 2]], bits3), train[at + 2], bits3)

    return grams


GRAMS_NONE = _arrow(GRAMS, chunk=[])


def _followed(read):
    """Rows of a part with the sums and numbers of the counts of what follows each word or n-gram, 0 for those that nothing kept follows."""

    def join(both: pa.Table) -> pa.Table:
        rows, contexts = both.filter(pa.compute.is_valid(both["chunk"])), both.filter(pa.compute.is_null(both["chunk"])).sort_by("a")
        known = contexts["a"].to_numpy()
        columns: dict[str, list] = {"total": [], "kinds": []}
        for name in rows["name"].to_pylist():
            at = _find(known, read(name) - 1)
            for k, found in columns.items():
                found.append(_packed(np.where(at >= 0, contexts[k].to_numpy()[at], 0) if len(known) else np.zeros(len(at), np.int64)))
        return _arrow(MODEL, **{k: rows[k].to_pylist() for k in ("chunk", "part", "x", "c", "name")}, **columns)

    return join


class Automaton:
    """States are kept contexts, 0 is the empty one. Arcs are sorted by (state << 32 | word), with next states and log10 probabilities; the root has one of each word."""

    def __init__(self, word_scores: list[float], word_counts: list[int], grams: dict[int, dict[int, int]], discount: float = DISCOUNT):
        """From all n-grams of a corpus of few words, 16 bits to a word."""
        twos, threes = sorted(grams.get(2, {}).items()), sorted((g, n) for g, n in grams.get(3, {}).items() if g >> 16 in grams.get(2, {}))
        column = lambda values: np.array([*values], np.int64)
        first, second, n_twos = column(g >> 16 for g, _ in twos), column(g & 0xFFFF for g, _ in twos), column(n for _, n in twos)
        pair = _find(_key(first, second), _key(column(g >> 32 for g, _ in threes), column(g >> 16 & 0xFFFF for g, _ in threes)))
        n_threes = column(n for _, n in threes)
        follow = np.bincount(first, weights=n_twos - discount, minlength=len(word_scores))
        pair_follow = np.bincount(pair, weights=n_threes - discount, minlength=len(twos))
        self._build(np.array(word_scores), np.array(word_counts), follow, (first, second, n_twos, pair_follow), (pair, column(g & 0xFFFF for g, _ in threes), n_threes), discount)

    @classmethod
    def of_chunk(cls, word_scores: np.ndarray, word_counts: np.ndarray, follow: np.ndarray, twos: tuple, threes: tuple, discount: float = DISCOUNT) -> Automaton:
        """From a chunk's words and n-grams with the corpus's counts, and for each context the discounted counts of all that follow it in the corpus."""
        self = cls.__new__(cls)
        self._build(word_scores, word_counts, follow, twos, threes, discount)
        return self

    def _build(self, word_scores: np.ndarray, word_counts: np.ndarray, follow: np.ndarray, twos: tuple, threes: tuple, discount: float) -> None:
        first, second, n_twos, pair_follow = twos
        pair, third, n_threes = threes
        self.word_scores, self.keys = word_scores, _key(first, second)
        ones, pairs = np.flatnonzero(follow > 0), np.flatnonzero(pair_follow > 0)
        self.of_word = np.zeros(len(word_scores), np.int64)
        self.of_word[ones] = np.arange(1, len(ones) + 1)
        own = np.zeros(len(first), np.int64)
        own[pairs] = np.arange(len(ones) + 1, len(ones) + len(pairs) + 1)
        self.of_pair = np.where(own > 0, own, self.of_word[second])
        weights = np.ones(len(ones) + len(pairs) + 1)
        weights[1 : len(ones) + 1] = 1 - follow[ones] / word_counts[ones]
        weights[len(ones) + 1 :] = 1 - pair_follow[pairs] / n_twos[pairs]
        self.fail = np.zeros(len(weights), np.int64)
        self.fail[len(ones) + 1 :] = self.of_word[second[pairs]]
        self.fail_score = np.log10(weights)
        base = 10.0**word_scores
        p_two = (n_twos - discount) / word_counts[first] + weights[self.of_word[first]] * base[second]
        middle = second[pair]
        shorter = _find(self.keys, _key(middle, third))
        known = shorter >= 0
        below = weights[self.of_word[middle]] * base[third]
        below[known] = p_two[shorter[known]]
        p_three = (n_threes - discount) / n_twos[pair] + weights[own[pair]] * below
        after = self.of_word[third]
        after[known] = self.of_pair[shorter[known]]
        arcs = np.concatenate([_key(self.of_word[first], second), _key(own[pair], third)])
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.next = np.concatenate([self.of_pair, after])[order]
        self.n_ones, self.p_two, self.p_three = len(ones), np.log10(p_two), np.log10(p_three)
        self.scores = np.concatenate([self.p_two, self.p_three])[order]

    def log_probability(self, state: int, word: int) -> tuple[int, float]:
        """The next state and the log10 probability of the word."""
        total = 0.0
        while state:
            at = int(_find(self.arcs, np.array([state << 32 | word]))[0])
            if at >= 0:
                return int(self.next[at]), total + float(self.scores[at])
            total += float(self.fail_score[state])
            state = int(self.fail[state])
        return int(self.of_word[word]), total + float(self.word_scores[word])

    def traverse(self, run: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        """The log10 probability of every word of texts with a gap of -1 after each; gaps have 0.

        two, three: which kept n-gram begins at each place, -1 for none. They tell the state before each word and whether it has an arc for the word.
        """
        state, before, longest = np.zeros(len(run), np.int32), np.full(len(run), -1, np.int32), np.full(len(run), -1, np.int32)
        word, before[1:], longest[2:] = run[:-1], two, three[:-2]
        state[1:] = np.where(word >= 0, self.of_word[word], 0)
        at = np.flatnonzero(two[:-1] >= 0)
        state[at + 2] = self.of_pair[two[at]]
        total = np.zeros(len(run))
        words = np.flatnonzero(run >= 0)
        left = words[state[words] > self.n_ones]
        arc = longest[left] >= 0
        total[left[arc]] += self.p_three[longest[left[arc]]]
        left = left[~arc]
        total[left] += self.fail_score[state[left]]
        state[left] = self.fail[state[left]]
        left = words[state[words] <= self.n_ones]
        arc = (state[left] > 0) & (before[left] >= 0)
        total[left[arc]] += self.p_two[before[left[arc]]]
        left = left[~arc]
        total[left] += self.fail_score[state[left]]
        total[left] += self.word_scores[run[left]]
        return total


def _scored(id_type: T.DataType, n_tokens: int, n_words: int, n_names: int, bits: int, bits3: int):
    """The rows of a chunk's documents with their scores, from its words (size 1), kept 2-grams and kept 3-grams with the corpus's counts."""
    schema = _fields(doc_id=id_type, held_out=T.BooleanType(), n_tokens=LONG, n_known=LONG, train_tokens=LONG, base_score=T.DoubleType(), score=T.DoubleType())

    def score(docs: pa.Table, model: pa.Table) -> pa.Table:
        words, twos, threes = (_of(model, size) for size in (1, 2, 3))
        follow = lambda rows: _joined(rows["total"]) - DISCOUNT * _joined(rows["kinds"])
        local, names = _joined(words["x"], _climbed), _names(words)
        counts, word_follow = np.zeros(len(local), np.int64), np.zeros(len(local))
        counts[local], word_follow[local] = _joined(words["c"]), follow(words)
        word_scores = np.log10((counts + 1) / (n_tokens + n_words + 1))
        run, doc, _ = _run(docs)
        # every kept n-gram stands somewhere in the chunk; any place of it tells its words
        pair = _find_mixed(_joined(twos["x"], _climbed), _pairs(run, names, bits, n_names), bits)
        c_two, pair_names = _joined(twos["c"]), _joined(twos["name"], _climbed) - 1
        stands = np.zeros(len(c_two), np.int64)
        at = np.flatnonzero(pair >= 0)
        stands[pair[at]] = at
        first, second = run[stands], run[stands + 1]
        order = np.argsort(_key(first, second))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        three = np.full(len(run), -1, np.int32)
        three[at] = _find_mixed(_joined(threes["x"], _climbed), _mixed(pair_names[pair[at]] * n_names + names[run[at + 2]], bits3), bits3)
        c_three = _joined(threes["c"])
        stands = np.zeros(len(c_three), np.int64)
        at = np.flatnonzero(three >= 0)
        stands[three[at]] = at
        automaton = Automaton.of_chunk(word_scores, counts, word_follow, (first[order], second[order], c_two[order], follow(twos)[order]), (place[pair[stands]] if len(stands) else stands, run[stands + 2] if len(stands) else stands, c_three))
        m, real = docs.num_rows, run >= 0
        total = lambda values: np.bincount(doc, weights=values, minlength=m)
        word = np.maximum(run, 0)
        found = [total(real).astype(np.int64), total(real & (counts[word] > 0)).astype(np.int64), np.full(m, n_tokens, np.int64), total(np.where(real, word_scores[word], 0.0)), total(automaton.traverse(run, np.where(pair >= 0, place[pair], np.int32(-1)) if len(place) else pair, three))]
        return pa.table([docs["doc_id"], docs["held_out"], *[pa.array(v) for v in found]], names=schema.names)

    return score, schema


def _contexts(counted: DataFrame) -> DataFrame:
    """What follows each context in all, by the part that has the context's name."""
    sums = counted.where("chunk is null").groupBy("a").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds"))
    return sums.select((F.col("a") % PARTS).alias("part"), "a", "total", "kinds")


def lm_scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, max_words: int | None = None, max_grams: int | None = None, least_count: int = LEAST_COUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    max_words and max_grams, if given, keep only words and n-grams with at least that fraction of all training tokens.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", text_or_empty().alias("text"), held.alias("held_out"))
    id_type = rows.schema["doc_id"].dataType
    number, schema = _numbered(id_type, chunk_bytes)
    table = materialize(rows.mapInArrow(number, schema), "numbered")
    words = table.where("words is not null").select("chunk", "part", "words", "local", "n")
    n_tokens = table.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    least = lambda most: max(least_count, -(-n_tokens // most) if most else 0)
    by_chunk = lambda rows: rows.groupBy("chunk")
    most = lambda rows: rows.agg(F.coalesce(F.max("most"), F.lit(0))).first()[0] or 1

    lexicon = materialize(_by_part(words, _count_words(least(max_words)), COUNTED), "lexicon")
    n_words, n_names = lexicon.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0], most(lexicon)

    # no n-gram occurs more often than its words or the shorter n-grams in it, so these are the only ones to look for
    docs = by_chunk(table.where("ids is not null").select("chunk", "doc_id", "held_out", "ids"))
    train = by_chunk(table.where("ids is not null").select("chunk", "held_out", "ids"))
    part = lambda rows, size, *columns: rows.where("chunk is not null").select("chunk", "part", F.lit(size).alias("size"), *columns)
    bits = _bits(n_names, n_names)
    grams = train.cogroup(by_chunk(part(lexicon, 1, "x", "name"))).applyInArrow(_twos(bits, n_names), GRAMS)
    twos = materialize(_by_part(grams, _count_grams(least(max_grams), bits, n_names), COUNTED), "twos")
    bits3 = _bits(most(twos), n_names)
    known = part(lexicon, 1, "x", "name").unionByName(part(twos, 2, "x", "name"))
    grams = train.cogroup(by_chunk(known)).applyInArrow(_threes(bits, bits3, n_names), GRAMS)
    threes = materialize(_by_part(grams, _count_grams(least(max_grams), bits3, n_names), COUNTED), "threes")

    own = ["chunk", "part", "x", "c", "name"]
    follow = lambda rows, longer, read: _by_part(rows.where("chunk is not null").select(*own).unionByName(_contexts(longer), allowMissingColumns=True), _followed(read), MODEL)
    columns = ["x", "c", "name", "total", "kinds"]
    none = F.lit(None).cast("binary")
    model = part(follow(lexicon, twos, _unpacked), 1, *columns).unionByName(part(follow(twos, threes, _climbed), 2, *columns))
    model = model.unionByName(part(threes, 3, "x", "c", none.alias("name"), none.alias("total"), none.alias("kinds")))
    score, schema = _scored(id_type, n_tokens, n_words, n_names, bits, bits3)
    return docs.cogroup(by_chunk(model)).applyInArrow(score, schema)
