"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the base spans (exact forms of e-mail addresses, IP addresses, card and phone numbers) and spans of wider forms: addresses
with the signs spelt out, national phone numbers, numbers grouped like cards, IPv6, bank accounts, social security numbers, secrets after
a key word and names. Five labelers vote for (+1), against (-1) or not at all on each: form, checksum, gazetteer, context before and
surroundings. Votes are counted by kind and pattern over all texts (at most 243 patterns a kind); on these counts expectation-maximisation
estimates, for each kind, how common personal data is and how each labeler votes on it and on the rest, and so the probability of each pattern.

These probabilities are the labels on which the span classifier is trained: a logistic regression over hashed features of a span's form and
its neighbouring words, which sees no votes, so it generalises to spans on which labelers are silent. It is fitted on at most
about SAMPLE candidates, drawn by a hash; the votes are counted on all. A candidate joins the spans if the classifier gives it LEAST or more and it
overlaps no base span. Base spans always stay.

Texts are read once, whole; what is found is written (no texts), counted and scored. The driver holds patterns, the sample and weights, all bounded.

Rows: one per input row, repeated rows too. Null and empty texts have no spans. Very long texts are read in one piece, in time linear in their
length. Of candidates of one kind that overlap, the leftmost counts; spans of different kinds may overlap, and those that start together
stand in the order of KINDS. Other columns are ignored by `personal_data` and kept by `masked`. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.storage import materialize

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret", "name"]
BASE_KINDS = 4
LABELERS = ["form", "checksum", "gazetteer", "before", "around"]
#: Candidates that the classifier is fitted on (about), its hashed features, and the probability from which a candidate counts.
SAMPLE, FEATURES, LEAST = 20_000, 4096, 0.5
EM_ROUNDS, FIT_ROUNDS = 30, 200

# The base forms.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider forms. Repeats are bounded or possessive, so a text is read in linear time.
AT = re.compile(r"(?:\(| \[|\[| \(| )(?:at|AT)(?:\)|\]| )")
SPELT_DOMAIN = re.compile(r" ?[A-Za-z0-9-]{1,63}+(?: ?[(\[ ](?:dot|DOT)[)\] ] ?[A-Za-z0-9-]{2,63}+)+")
NATIONAL = re.compile(r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])(?:[0-9]{2,4}[ .-]){1,4}[0-9]{2,4}(?![0-9.])")
GROUPED = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._][0-9]{4}){3}(?![0-9])")
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
VALUE = re.compile(r"[=:][ \t]{0,3}[\"'`]?([^\s\"'`,;=]{8,}+)")
KEY = re.compile(r"(?:token|secret|passwor[dt]|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential)[\"'`]?[ \t]{0,3}$", re.I)
VENDOR = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,64})(?![A-Za-z0-9])")
NAME = re.compile(r"(?<![A-Za-z])[A-Z][a-zà-ÿ'’-]{1,30}+(?: [A-Z]\.)?(?: [A-Z][a-zà-ÿ'’-]{1,30}+){1,2}")
DIGIT = re.compile(r"[0-9]")

#: Gazetteers: first names, titles and words that begin no name; endings of hosts; prefixes of accounts.
FIRST_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna peter paul maria jan hans klaus petra sabine "
    "stefan andreas pierre jean marie claire luc sophie antoine carlos juan jose ana luis carmen lucia miguel giulia marco luca laura daniel martin simon emma noah olivia liam mia lena".split()
)
NO_NAME = frozenset("the a an of and or in on at to for by with from this that these those it is was are be as not he she they we you i der die das und le la les el los las un une ein eine de du des".split())
TITLES = frozenset("mr mrs ms miss dr prof sir madam herr frau monsieur madame mme sr sra señor señora don doña signor signora".split())
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app eu de fr es it uk nl ch at be pl se no dk fi pt cz us ca au jp cn in br mx".split())
COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR VG XK".split())
#: Words that announce each kind, and words that announce other numbers.
CUES = {
    "email": "mail email e-mail mailto contact write address reach",
    "ip": "ip host server address client addr",
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta",
    "phone": "phone tel telephone call fax mobile cell telefon téléphone teléfono whatsapp contact",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
    "secret": "token secret password passwd pwd key credential",
    "name": "name named contact dear signed author regards sincerely call mr mrs ms dr prof herr frau mme sr sra",
}
CUES = {kind: frozenset(words.split()) for kind, words in CUES.items()}
AGAINST = frozenset("version isbn issn page pages fig figure eq equation line lines chapter section table no nr vol doi id sku item part model build release".split())
WORDS = re.compile(r"[\w-]+")
SHAPES = [(re.compile(r"[0-9]"), "9"), (re.compile(r"[A-Z]"), "A"), (re.compile(r"[a-zà-ÿ]"), "a"), (re.compile(r"(.)\1{3,}"), r"\1\1\1+")]


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(double)) % 10 == 0


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses, leftmost first: the run of letters before a sign, and a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if local else None
        free = at + 1
        if found:
            yield at - local, found.end()
            free = found.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the exact forms, sorted."""
    found = [(a, 0, b) for a, b in _mails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _wider(text: str) -> Iterator[tuple[int, int, int]]:
    for m in AT.finditer(text):
        begin = max(0, m.start() - 64)
        before = text[begin : m.start()]
        local = len(before) - len(before.rstrip(LOCAL))
        if local and (end := SPELT_DOMAIN.match(text, m.end())):
            yield m.start() - local, 0, end.end()
    if DIGIT.search(text):
        for kind, form in ((3, NATIONAL), (2, GROUPED), (1, IP6), (4, IBAN), (5, SSN)):
            for m in form.finditer(text):
                if kind != 3 or 9 <= len(_digits(m[0])) <= 15:
                    yield m.start(), kind, m.end()
        for m in VENDOR.finditer(text):
            yield m.start(), 6, m.end()
    for m in VALUE.finditer(text):
        if KEY.search(text, max(0, m.start() - 24), m.start()):
            end = m.end(1)
            while end > m.start(1) and text[end - 1] in "!.?)]}*#%&$|":
                end -= 1
            if end - m.start(1) >= 8:
                yield m.start(1), 6, end
    for m in NAME.finditer(text):
        title = m[0].partition(" ")[0]
        yield m.start() + (len(title) + 1 if title.lower() in TITLES else 0), 7, m.end()


def _entropy(span: str) -> float:
    return -sum((n := span.count(c)) / len(span) * math.log2(n / len(span)) for c in set(span))


def votes(text: str, start: int, kind: int, end: int, base: bool) -> list[int]:
    """What each of LABELERS says of a span."""
    span, name = text[start:end], KINDS[kind]
    digits, words = _digits(span), WORDS.findall(span.lower())
    before = WORDS.findall(text[max(0, start - 40) : start].lower())[-4:]
    form = 1 if base else 0
    checksum = gazetteer = 0
    if name == "email":
        gazetteer = 1 if words and words[-1] in ENDINGS else -1
        form = 1 if base or "(" in span or "[" in span else -1
    elif name == "ip":
        form = 1
        checksum = -1 if base and span.startswith(("0.", "00")) else 0
    elif name == "card":
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif name == "phone":
        form = 1 if base or span.startswith(("(", "00")) else 0 if span.startswith("0") else -1
        checksum = -1 if len(set(digits)) <= 2 else 0
    elif name == "iban":
        plain = span.replace(" ", "")
        checksum = 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
        gazetteer = 1 if plain[:2] in COUNTRIES else -1
    elif name == "ssn":
        checksum = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 0
        form = 1
    elif name == "secret":
        form = 1 if VENDOR.fullmatch(span) or (digits and re.fullmatch(r"[A-Za-z0-9+/=_.~-]+", span)) else -1
        checksum = 1 if _entropy(span) >= 3.0 else -1
    elif name == "name":
        gazetteer = 1 if words[0] in FIRST_NAMES else -1 if any(w in NO_NAME for w in words) else 0
        form = -1 if text[max(0, start - 4) : start].rstrip()[-1:] in (".", "!", "?", "") else 0
    cue = 1 if any(w in CUES[name] or (name == "name" and w in TITLES) for w in before) else -1 if any(w in AGAINST for w in before) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    # within a path, a name of a variable or an address it is part of something else; ordinary surroundings say nothing
    around = -1 if left in tuple("/\\_#&@$") or right in tuple("/\\_@") else 0
    return [form, checksum, gazetteer, cue, around]


def features(text: str, start: int, kind: int, end: int) -> list[int]:
    """Hashed features of a span's form and of the words beside it."""
    span, name = text[start:end], KINDS[kind]
    shape = span[:80]
    for form, mark in SHAPES:
        shape = form.sub(mark, shape)
    before = WORDS.findall(text[max(0, start - 40) : start].lower())[-2:]
    after = WORDS.findall(text[end : end + 24].lower())[:1]
    said = [name, f"{name} shape {shape}", f"{name} start {shape[:4]}", f"{name} length {min(len(span), 40) // 4}", f"{name} digits {min(len(_digits(span)), 20)}"]
    said += [f"{name} before {w}" for w in before] + [f"{name} after {w}" for w in after] + [f"{name} left {text[start - 1 : start]}", f"{name} right {text[end : end + 1]}"]
    if name == "name":
        said += [f"name word {w.lower()}" for w in span.split()]
    if name == "email":
        said.append(f"email ending {span[-4:].lower()}")
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in said})


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """The base spans of a text, and all candidates (base ones too) with votes and features."""
    base = base_spans(text)
    every = [(*span, True) for span in base]
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    last = [0] * len(KINDS)
    for start, kind, end in sorted(_wider(text)):
        before = bisect_left(starts, end)  # base spans that start before this one ends
        if start < last[kind] or (before and reach[before - 1] > start):
            continue
        last[kind] = end
        every.append((start, kind, end, False))
    return base, [
        {"kind": kind, "start": start, "end": end, "base": own, "votes": sum((v + 1) * 3**j for j, v in enumerate(votes(text, start, kind, end, own))), "features": features(text, start, kind, end)}
        for start, kind, end, own in sorted(every)
    ]


# ---- aggregation ----


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = EM_ROUNDS) -> tuple[dict[tuple[int, int], float], dict[str, dict]]:
    """The probability of personal data for each (kind, pattern), and for each kind the estimates it follows from.

    counts: candidates by (kind, pattern). Estimates start from the balance of votes and keep a few pseudo-counts of a labeler that is better than a coin,
    so a kind of few candidates stays near the balance of its votes.
    """
    chance, told = {}, {}
    start = np.array([[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]])  # votes -1, 0, 1 on the rest and on personal data
    for kind in sorted({k for k, _ in counts}):
        patterns = sorted(p for k, p in counts if k == kind)
        n = np.array([counts[kind, p] for p in patterns], dtype=float)
        cast = np.array([[p // 3**j % 3 for j in range(len(LABELERS))] for p in patterns])
        balance = (cast - 1).sum(1)
        posterior = 1 / (1 + np.exp(-1.5 * balance))
        votes_of = np.stack([(cast == v).astype(float) for v in range(3)], axis=2)
        for _ in range(rounds):
            share = (n @ posterior + 1) / (n.sum() + 2)
            table = np.empty((2, len(LABELERS), 3))
            for y, weight in ((0, n * (1 - posterior)), (1, n * posterior)):
                heard = np.einsum("p,pjv->jv", weight, votes_of) + 4 * start[y]
                table[y] = heard / heard.sum(1, keepdims=True)
            odds = np.log(share / (1 - share)) + np.zeros(len(patterns))
            for j in range(len(LABELERS)):  # silence says nothing
                said = cast[:, j] != 1
                spoken = table[:, j, :] / (table[:, j, 0] + table[:, j, 2])[:, None]
                odds += np.where(said, np.log(spoken[1, cast[:, j]] / spoken[0, cast[:, j]]), 0.0)
            posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        chance |= {(kind, p): float(x) for p, x in zip(patterns, posterior)}
        told[KINDS[kind]] = {"share": float(share), "right": {name: [float(table[1, j, 2]), float(table[0, j, 0])] for j, name in enumerate(LABELERS)}}
    return chance, told


def fit_classifier(rows: list[list[int]], labels: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Weights of a logistic regression (the last is the intercept) on labels between 0 and 1, by gradient steps scaled by each feature's use."""
    weights = np.zeros(FEATURES + 1)
    if not len(rows):
        return weights
    at = np.concatenate([np.array([*r, FEATURES]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    used = np.bincount(at, minlength=FEATURES + 1) + 4.0
    per_row = max(len(r) + 1 for r in rows)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(row, weights[at], minlength=len(rows))))
        slope = np.bincount(at, (labels - p)[row], minlength=FEATURES + 1) - 0.02 * weights
        weights += 4 * slope / (used * per_row) * 2
    return weights


def probability(found: list[int], weights: np.ndarray) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, float(weights[found].sum() + weights[FEATURES])))))


SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:array<int>>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id and candidates of every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [candidates(text.as_py() or "")[1] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN_TYPE)], names=["doc_id", "spans"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(find, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def fitted(found: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, dict]]:
    """The classifier's weights and the labelers' estimates, from all candidates of found_spans()."""
    every = found.select(F.explode("spans").alias("s")).select("s.*")
    counts = {(r["kind"], r["votes"]): r["n"] for r in every.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}  # at most 243 a kind
    chance, told = reliabilities(counts)
    n, buckets = sum(counts.values()), 1 << 20
    share = min(buckets, -(-sample * buckets // max(n, 1)))
    # the hash is of what the classifier sees, so equal candidates are all in or all out; they are counted before the limit
    drawn = every.where(F.pmod(F.xxhash64("features"), F.lit(buckets)) < share).groupBy("features", "kind", "votes").agg(F.count("*").alias("n")).limit(4 * sample).collect()
    drawn.sort(key=lambda r: (r["features"], r["kind"], r["votes"]))
    rows, labels = [], []
    for r in drawn:
        copies = min(r["n"], 8)  # of one form that fills the corpus, the classifier needs no more
        rows += [r["features"]] * copies
        labels += [chance[r["kind"], r["votes"]]] * copies
    return fit_classifier(rows, np.array(labels)), told


def _chosen(spans: list[dict], weights: np.ndarray) -> list[tuple[int, int, int]]:
    return sorted((s["start"], s["kind"], s["end"]) for s in spans if s["base"] or probability(s["features"], weights) >= LEAST)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    found = materialize(found_spans(docs), "spans")
    weights, _ = fitted(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in range(BASE_KINDS)], [], []
            for own in batch.column(1).to_pylist():
                base = sorted((s["start"], s["kind"], s["end"]) for s in own if s["base"])
                for kind in range(BASE_KINDS):
                    counts[kind].append(sum(1 for s in base if s[1] == kind))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(_chosen(own, weights)))
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f"n_{k}" for k in KINDS[:BASE_KINDS]], "base_sha256", "spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(decide, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(docs: DataFrame) -> DataFrame:
    """`docs` with each span's text replaced by its kind in brackets, by a model fitted on their own candidates."""
    weights, _ = fitted(materialize(found_spans(docs.select("doc_id", "text")), "spans"))
    place = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(place):
                text = value.as_py()
                if text is not None:
                    parts, at = [], 0
                    for start, kind, end in _chosen(candidates(text)[1], weights):
                        if start >= at:
                            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
                        at = max(at, end)
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            arrays = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(mask, docs.withColumn("text", F.col("text").cast("string")).schema)
