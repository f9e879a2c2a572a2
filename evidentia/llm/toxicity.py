"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel: two strings are as similar as the gapped three-letter subsequences they share, each weighed by DECAY to the letters
it spans, within SPAN letters; so an inserted, missing or changed letter or a space costs a factor and not the similarity. A
sentence is read as its words, its pairs of short neighbouring words with the space as a gap, and letters set apart by
spaces as one word; signs within words are passed over. These are the units that the machine sees.

Training, on a bounded sample of labelled documents outside the held-out fold, is multiple-instance learning over their sentences: a
sentence is a bag of units and stands for the unit of the largest margin, its witness. Sentences of documents that aren't
toxic are the clean examples. Those of toxic documents whose witness is much more frequent in toxic documents are the toxic
ones, each also with copies in which a letter is inserted, left out or changed or a space put in, so that the machine learns to
tolerate these. The first witnesses start like stems that between them tell the toxic documents best; the machine (squared
hinge, solved in the primal, on Nyström features) then picks the next, ROUNDS times, and the clean witnesses nearest to the toxic side join the landmarks.

Calibration, on documents that are left out of the fitting: a logistic curve, whose slopes are 0 or more, over each document's
three largest margins and its share of units on the toxic side; toxic documents count as they are and with altered insults.
Its shift makes TOXIC_SCORE the best cut there, reached by at most FALSE_SHARE of the clean ones.

Scoring: since the kernel is a product over subsequences, the fitted machine folds into one weight for each subsequence of the
landmarks, and a unit's margin is a sum over a table of them, taken for many units at once. Whole texts are read in one
pass and nothing is shuffled. Broadcast: the folded weights, bounded by the number of landmarks.

Rows: one per input row. Null and empty texts have no unit and score as a unit that shares nothing with any landmark. Labels
with a null doc_id or label are ignored, repeated labels count once in the sample. Without labels of both kinds, or without any
stem that tells them apart, every score is 0. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import text_or_empty
from evidentia.storage import materialize

FOLDS, HELD_OUT, TOXIC_SCORE = 3, 1, 0.7
#: Bounds of what the classifier is fitted on: labelled documents of each kind, units of each kind.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WORDS = 2500, 5000, 3000
#: Of the sample, one document of so many is left out for calibration.
LEFT_OUT = 4
#: The share of clean documents that may reach TOXIC_SCORE, and what one caught wrongly costs against one missed, as shares of their kinds.
FALSE_SHARE, FALSE_COST = 0.015, 5.0
TOXIC_LANDMARKS, CLEAN_LANDMARKS, HARD_LANDMARKS, ROUNDS = 96, 64, 32, 3
DECAY, SPAN, WINDOW = 0.8, 5, 24
#: Neighbouring words of so many letters together are also read as one word with a gap.
PAIR_LETTERS = 11
#: Stems that tell: so much more frequent in toxic documents (log-odds), in so many of them (of a small sample, one in LEAST_OF), and new to as many (see _stems).
LEAST_ODDS, LEAST_DOCS, LEAST_OF, STEMS = 2.0, 5, 20, 1000
#: The weight of altered copies among the toxic examples.
ALTERED_WEIGHT = 0.5
SIGNS = re.compile(r"[^\w\s]+|_+")
APART = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
SENTENCE_ENDS = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letters of landmarks that the folded machine tells apart; beyond, the rarest share numbers and add up.
MOST_LETTERS = 160
#: Characters of units that are scored at once, and words whose margins a task remembers.
SCORED_CHARS, REMEMBERED = 1 << 18, 1 << 19

_STEPS = [(j, k, DECAY ** (k + 1)) for k in range(2, SPAN) for j in range(1, k)]
#: A unit's length in feature space if no subsequence repeats, by its letters: what its features are divided by.
_NORMS = np.array([max(sum(max(0, n + 2 - k) * w * w for _, k, w in _STEPS), 1e-12) ** 0.5 for n in range(WINDOW + 1)])
_GAP = "$" + "\0" * (SPAN - 1) + "^"


def subsequences(unit: str) -> dict[str, float]:
    """The gapped three-letter subsequences of a unit of up to WINDOW characters between its two ends, with their weights; spaces are gaps."""
    marked = f"^{unit}$"
    found: dict[str, float] = {}
    for j, k, weight in _STEPS:
        for a, b, c in zip(marked, marked[j:], marked[k:]):
            if " " not in (a, b, c):
                found[a + b + c] = found.get(a + b + c, 0.0) + weight
    norm = _NORMS[len(unit)]
    return {key: v / norm for key, v in found.items()}


def kernel(a: dict[str, float], b: dict[str, float]) -> float:
    if len(b) < len(a):
        a, b = b, a
    return sum(v * b[key] for key, v in a.items() if key in b)


def units(text: str) -> tuple[list[str], list[str]]:
    """The words of a text in lower case without signs (letters set apart by spaces as one word; of long words, overlapping stretches), and its pairs of short words."""
    words = SIGNS.sub("", text.lower()).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:]) if len(a) + len(b) <= PAIR_LETTERS]
    words += [SIGNS.sub("", "".join(run[0].split())).lower() for run in APART.finditer(text)]
    if max(map(len, words), default=0) > WINDOW:
        words = [part for word in words for part in ([word] if len(word) <= WINDOW else [word[at : at + WINDOW] for at in range(0, len(word) - WINDOW // 2, WINDOW // 2)])]
    return [w for w in words if w], pairs


def altered(word: str, kind: int, salt: str = "") -> str:
    """The word with a letter inserted (kinds 0 to 3), left out (4) or changed (5), two inserted (6), or a space put in (7); where, the word decides."""
    n = len(word)
    if n < 4:
        return word
    at = [zlib.crc32(f"{salt}{kind}{k}{word}".encode("utf-8", "surrogatepass")) >> 7 for k in range(4)]
    letters = [LETTERS[x % 26] for x in at[2:]]
    i = 1 + at[0] % (n - 1)
    if kind == 4:
        return word[: min(i, n - 2)] + word[min(i, n - 2) + 1 :]
    if kind == 5:
        return word[: min(i, n - 2)] + letters[0] + word[min(i, n - 2) + 1 :]
    if kind == 6:
        i, j = sorted((i, 1 + at[1] % (n - 1)))
        return word[:i] + letters[0] + word[i:j] + letters[1] + word[j:]
    return word[:i] + (" " if kind == 7 else letters[0]) + word[i:]


KINDS = 8


class Machine:
    """The fitted machine, folded: a weight for each subsequence, a bias, and the logistic curve over a text's margins."""

    def __init__(self, weights: dict[str, float], bias: float, curve: tuple[float, ...] = (0.0,) * 5):
        self.weights, self.bias, self.curve = weights, bias, curve
        letters: dict[str, float] = {}
        for key, v in weights.items():
            for letter in key:
                letters[letter] = letters.get(letter, 0.0) + abs(v)
        ranked = sorted(letters, key=lambda x: (-letters[x], x))
        self.size = min(len(ranked), MOST_LETTERS) + 1
        self.number = np.zeros(0x110000, np.uint8)
        self.number[[ord(x) for x in ranked]] = [1 + k if k < MOST_LETTERS else MOST_LETTERS - k % (MOST_LETTERS // 2) for k in range(len(ranked))]
        self.table = np.zeros(self.size**3, np.float32)
        for key, v in weights.items():
            a, b, c = (int(self.number[ord(x)]) for x in key)
            self.table[(a * self.size + b) * self.size + c] += v
        self.known: dict[str, float] = {}

    def margins(self, of: list[str]) -> np.ndarray:
        """The margins of units of 1 to WINDOW characters."""
        out = np.empty(len(of))
        lengths = np.fromiter(map(len, of), np.int64, len(of))
        at = 0
        while at < len(of):
            end = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]) + 6 * np.arange(len(of) - at), SCORED_CHARS)) + at)
            own = lengths[at:end]
            flat = "^" + _GAP.join(of[at:end]) + "$" + "\0" * SPAN
            code = self.number[np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
            n = len(code) - SPAN + 1
            hit = np.zeros(n, np.float32)
            first, second = code * (self.size * self.size), code * self.size
            for j, k, weight in _STEPS:
                hit += np.float32(weight) * self.table[first[:n] + second[j : j + n] + code[k : k + n]]
            # letters without a number stand in no weighted subsequence, and the gaps keep units apart
            starts = np.concatenate([[0], np.cumsum(own[:-1] + 2 + SPAN - 1)])
            out[at:end] = np.add.reduceat(hit.astype(np.float64), starts) / _NORMS[own]
            at = end
        return self.bias + out

    def word_margins(self, words: list[str]) -> np.ndarray:
        """The same for words, which repeat: those seen before are remembered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.known.update(zip(new, self.margins(new).tolist()))
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text the three largest margins of its units, and the logarithm of the share of units on the toxic side."""
        best = np.full((len(texts), 3), self.bias)
        toxic, total = np.zeros(len(texts)), np.zeros(len(texts))
        held: tuple[list[str], list[str]] = ([], [])
        ends: tuple[list[tuple[int, int]], list[tuple[int, int]]] = ([], [])

        def flush() -> None:
            for margins, rows in ((self.word_margins(held[0]), ends[0]), (self.margins(held[1]), ends[1])):
                start = 0
                for row, end in rows:
                    own, start = margins[start:end], end
                    if len(own):
                        best[row] = np.sort(np.concatenate([best[row], own if len(own) <= 3 else np.partition(own, -3)[-3:]]))[-3:][::-1]
                        toxic[row] += (1 / (1 + np.exp(-4 * (own - 0.2)))).sum()
                        total[row] += len(own)
            for k in (0, 1):
                held[k].clear()
                ends[k].clear()

        for row, text in enumerate(texts):
            both = units(text)
            for at in range(0, max(map(len, both)), SCORED_CHARS):
                for k in (0, 1):
                    held[k].extend(both[k][at : at + SCORED_CHARS])
                    ends[k].append((row, len(held[k])))
                if len(held[0]) >= SCORED_CHARS // 8:
                    flush()
        flush()
        return np.column_stack([best, np.log((toxic + 0.05) / (total + 10))])

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve[:-1] + self.curve[-1], -40, 40)))

    def alter(self, text: str, salt: str) -> str:
        """The text with its words on the toxic side altered, each text in one way."""
        kind = zlib.crc32(salt.encode()) % KINDS
        bad = {w for w in set(WORD.findall(text.lower())) if 4 <= len(w) <= WINDOW}
        bad = {w for w, m in zip(bad, self.margins(list(bad))) if m > 0.3}
        return WORD.sub(lambda found: altered(found[0], kind, salt) if found[0].lower() in bad else found[0], text)

    def parts(self) -> tuple[dict[str, float], float, tuple[float, ...]]:
        return self.weights, self.bias, self.curve


def _newton_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """The squared-hinge machine in the primal; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-8
    for _ in range(50):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xo = x[on] * weight[on, None]
        step = np.linalg.solve(xo.T @ x[on] + np.diag(penalty), xo.T @ y[on])
        if np.abs(step - w).max() < 1e-9:
            break
        w = 0.3 * w + 0.7 * step if _ > 25 else step
    return w


def fit_machine(landmarks: list[str], toxic: list[str], clean: list[str], toxic_weights: np.ndarray | None = None) -> tuple[Machine, np.ndarray]:
    """Nyström features over the landmarks, then the machine, folded into weights of subsequences; and the weight of each landmark in it."""
    own = [subsequences(w) for w in landmarks]
    names = {key: k for k, key in enumerate(sorted({key for s in own for key in s}))}

    def matrix(of: list[str]) -> np.ndarray:
        rows = np.zeros((len(of), len(names)), dtype=np.float32)
        for row, unit in zip(rows, of):
            for key, v in subsequences(unit).items():
                if key in names:
                    row[names[key]] = v
        return rows

    at = matrix(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(at @ at.T)
    keep = values > 1e-6
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    project = at.T @ whiten  # subsequences to Nyström features
    both = [*toxic, *clean]
    x = np.concatenate([matrix(both[i : i + 1000]) @ project for i in range(0, len(both), 1000)])
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    share = np.ones(len(toxic)) if toxic_weights is None else toxic_weights
    weight = np.concatenate([share / share.sum(), np.full(len(clean), 1 / len(clean))])
    w = _newton_svm(np.hstack([x, np.ones((len(x), 1))]), y, weight, 1e-4)
    folded = project @ w[:-1]
    return Machine({key: float(folded[k]) for key, k in names.items()}, float(w[-1])), whiten @ w[:-1]


def _with_altered(counts: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Toxic units and their altered copies, with weights: a unit's grows with the root of its count."""
    found: list[str] = []
    weights: list[float] = []
    for unit, n in counts.items():
        copies = [altered(unit, kind)[:WINDOW] for kind in range(KINDS)]
        found += [unit, *copies]
        weights += [n**0.5 * (1 - ALTERED_WEIGHT), *[n**0.5 * ALTERED_WEIGHT / KINDS] * KINDS]
    return found, np.array(weights)


def _logistic(features: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Slopes (0 or more) and shift of a logistic curve, by damped Newton steps on standardised features; both classes weigh the same. A feature whose slope would be negative is left out."""
    middle, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    on = list(range(features.shape[1]))
    while True:
        x = np.column_stack([((features - middle) / spread)[:, on], np.ones(len(features))])
        ridge = np.append(np.ones(len(on)), 1e-6)
        w = np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(hessian, x.T @ (weight * (labels - p)) - ridge * w)
            w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        kept = [k for k, slope in zip(on, w) if slope >= 0]
        if len(kept) == len(on):
            break
        on = kept
    slopes = np.zeros(features.shape[1])
    slopes[on] = w[:-1] / spread[on]
    return (*slopes.tolist(), float(w[-1] - slopes @ middle))


def _calibrated(features: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """The curve, shifted so that TOXIC_SCORE is the best cut: where the share of toxic rows missed and FALSE_COST times the share of clean ones caught add up to least, of cuts that at most FALSE_SHARE of the clean ones reach."""
    *slopes, shift = _logistic(features, labels)
    z = features @ slopes + shift
    clean, toxic = np.sort(z[labels == 0]), np.sort(z[labels > 0])
    false = np.arange(-(-FALSE_SHARE * len(clean) // 1) + 1).astype(int)
    false = false[false < len(clean)]
    cuts = clean[len(clean) - 1 - false] + 0.05
    cost = np.searchsorted(toxic, cuts) / len(toxic) + FALSE_COST * (len(clean) - np.searchsorted(clean, cuts)) / len(clean)
    return (*slopes, float(shift - cuts[cost.argmin()] + np.log(TOXIC_SCORE / (1 - TOXIC_SCORE))))


def _fold(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and left_out of at most SAMPLE_TOXIC and SAMPLE_CLEAN documents outside the held-out fold, first by hash."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (_fold(F.col("doc_id")) != HELD_OUT))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = usable.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(usable.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    picked = picked.withColumn("left_out", F.pmod(F.xxhash64("doc_id", F.lit("left out")), F.lit(LEFT_OUT)) == 0)
    # bounded by the two limits, at any size of the labels
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")
    found = found.select(F.col("doc_id").cast("string"), "text", "toxic", "left_out").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    return materialize(found, "labelled")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [[*dict.fromkeys(units(text)[0])] for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])


def _stems(pairs: list[tuple[str, str, float]], least: float) -> list[str]:
    """Stems (stem, toxic document, odds), best first: each counts the documents it is in, halved by every stem chosen before that is in them too."""
    inside, odds = defaultdict(list), {}
    for stem, doc, worth in pairs:
        inside[stem].append(doc)
        odds[stem] = worth
    seen, chosen = Counter(), []
    while len(chosen) < TOXIC_LANDMARKS:
        new = {stem: sum(0.5 ** seen[d] for d in docs) for stem, docs in inside.items() if not any(stem.startswith(x) or x.startswith(stem) for x in chosen)}
        best = max(((n * odds[stem], len(stem), stem) for stem, n in new.items() if n >= least), default=None)
        if best is None:
            break
        chosen.append(best[2])
        seen.update(inside[best[2]])
    return chosen


def _witnesses(parts: tuple):
    """The units of sentences that may be witnesses: of clean documents the one of the largest margin, of toxic ones the words on the toxic side."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*parts)
        for batch in batches:
            of, bags = [], []
            for text, doc_id, toxic in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for k, sentence in enumerate(SENTENCE_ENDS.split(text)):
                    words, pairs = units(sentence)
                    own = words if toxic else words + pairs
                    if own:
                        bags.append((doc_id, k, toxic, len(of), len(of) + len(own)))
                        of += own
            margins, rows = machine.margins(of), []
            for doc_id, k, toxic, start, end in bags:
                own = margins[start:end]
                rows += [(doc_id, k, toxic, of[start + i], float(own[i])) for i in (np.flatnonzero(own > 0.2) if toxic else [own.argmax()])]
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sentence", "toxic", "unit", "margin"])

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
    return find


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine for these labels; None if a kind of label is missing or nothing tells them apart."""
    sample = labelled_sample(docs, labels)
    totals = {(r["toxic"], r["left_out"]): r["count"] for r in sample.groupBy("toxic", "left_out").count().collect()}
    if not {1, 0} <= {toxic for toxic, _ in totals}:
        return None
    # a sample too small to leave anything out is calibrated on itself
    enough = all(totals.get((toxic, left), 0) >= 5 for toxic in (0, 1) for left in (False, True))
    fitted, left_out = (sample.where("not left_out"), sample.where("left_out")) if enough else (sample, sample)
    n_toxic, n_clean = (sum(n for (toxic, left), n in totals.items() if toxic == kind and not (enough and left)) for kind in (1, 0))
    words = fitted.select("text", "doc_id", "toxic").mapInArrow(_words, "doc_id string, toxic int, words array<string>").select("doc_id", "toxic", F.explode("words").alias("word"))
    words = materialize(words, "words")
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))

    def counted(rows: DataFrame) -> DataFrame:
        kinds = [F.sum(F.col("toxic")).alias("t"), F.sum(1 - F.col("toxic")).alias("c")]
        return rows.groupBy("word").agg(*kinds).withColumn("odds", odds)

    by_word = materialize(counted(words), "counted")
    starts = words.where(F.length("word") >= 4).select("doc_id", "toxic", F.explode(F.transform(F.sequence(F.lit(4), F.least(F.length("word"), F.lit(10))), lambda n: F.substring("word", F.lit(1), n))).alias("word"))
    starts = starts.distinct()
    least = min(LEAST_DOCS, max(2.0, n_toxic / LEAST_OF))
    telling = counted(starts).where((F.col("t") >= least) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc(F.col("t") * F.col("odds")), F.desc(F.length("word")), "word").limit(STEMS)
    # bounded: STEMS stems in SAMPLE_TOXIC documents
    inside = starts.where("toxic = 1").join(F.broadcast(telling.select("word", "odds")), "word").select("word", "doc_id", "odds")
    stems = _stems([*inside.toPandas().itertuples(index=False, name=None)], least)
    if not stems:
        return None

    def listed(rows: DataFrame, order: list, n: int) -> list[str]:
        return rows.orderBy(*order).limit(n).toPandas().iloc[:, 0].tolist()

    first = by_word.where((F.col("t") > 0) & (F.col("odds") > 0) & F.col("word").rlike("^(?:" + "|".join(map(re.escape, stems)) + ")"))
    toxic = {r["word"]: r["t"] for r in first.orderBy(F.desc("t"), "word").limit(SAMPLE_WORDS).collect()}
    others = by_word.where("c > 0 and odds < 1").select("word", "c")
    common = listed(others, [F.desc("c"), "word"], SAMPLE_WORDS // 3)
    clean = listed(others, [F.xxhash64("word"), "word"], SAMPLE_WORDS)
    if not toxic or not clean:
        return None
    landmarks = list(dict.fromkeys([*stems, *list(toxic)[:TOXIC_LANDMARKS], *common[:CLEAN_LANDMARKS]]))
    known = list(dict.fromkeys([*common, *clean]))
    units_of, weights = _with_altered(toxic)
    machine, _ = fit_machine(landmarks, units_of, known, weights)
    for _ in range(ROUNDS):
        schema = "doc_id string, sentence int, toxic int, unit string, margin double"
        found = materialize(fitted.select("text", "doc_id", "toxic").mapInArrow(_witnesses(machine.parts()), schema), "witnesses")
        telling = by_word.where((F.col("odds") > 1) & (F.length("word") >= 3)).select(F.col("word").alias("unit"))
        sentences = found.where("toxic = 1").join(telling, "unit", "left_semi").groupBy("doc_id", "sentence").agg(F.max(F.struct("margin", "unit")).alias("best"))
        witness = sentences.groupBy(F.col("best.unit").alias("unit")).count().orderBy(F.desc("count"), "unit").limit(SAMPLE_WORDS)
        toxic = {r["unit"]: r["count"] for r in witness.collect()} or toxic
        against = found.where("toxic = 0").groupBy("unit").agg(F.max("margin").alias("margin"))
        hard = listed(against, [F.desc("margin"), "unit"], SAMPLE_WORDS)
        usual = listed(against, [F.xxhash64("unit"), "unit"], SAMPLE_WORDS)
        landmarks = list(dict.fromkeys([*landmarks, *hard[:HARD_LANDMARKS]]))
        units_of, weights = _with_altered(toxic)
        machine, _ = fit_machine(landmarks, units_of, list(dict.fromkeys([*known, *hard, *usual])), weights)

    parts = machine.parts()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*parts)
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            changed = [own.alter(text, doc_id) for text, doc_id, bad in zip(texts, batch.column(1).to_pylist(), toxic) if bad]
            found = own.features([*texts, *changed])
            yield pa.RecordBatch.from_arrays([pa.array([*toxic, *[1] * len(changed)], pa.int32()), *map(pa.array, found.T.copy())], names=["toxic", "a", "b", "c", "d"])

    found = left_out.select("text", "doc_id", "toxic").mapInArrow(features, "toxic int, a double, b double, c double, d double").toPandas().to_numpy(float)
    machine.curve = _calibrated(found[:, 1:], found[:, 0])
    return machine


def _mapped(rows: DataFrame, machine: Machine | None, text: str, schema: T.StructType, keep):
    """`rows` through `keep`, which makes a batch of a batch and the scores of its column `text`."""
    at = rows.columns.index(text)
    shared = rows.sparkSession.sparkContext.broadcast(machine.parts() if machine else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield keep(batch, own.scores(texts) if own else np.zeros(len(texts)))

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])
    scored = _mapped(rows, fit(docs, labels), "text", schema, lambda batch, scores: pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"]))
    return scored.select("doc_id", (_fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with all columns."""
    # in one column, whatever the names of the others
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("own"), text_or_empty().alias("text"))
    kept = _mapped(rows, fit(docs, labels), "text", rows.schema, lambda batch, scores: batch.filter(pa.array(scores < TOXIC_SCORE)))
    return kept.select("own.*")
