import re
from collections import Counter, defaultdict

from evidentia.llm import quality_rules
from evidentia.llm.registry import ORACLES

SPACE = r"[\x20\x09-\x0D]"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), lines, text


def edge(value):
    shift = max(0, value.bit_length() - 6)
    return value >> shift << shift


def brute(rows):
    measured, groups = [], defaultdict(list)
    for doc_id, text, lang, source in rows:
        n, chars, symbols, dups, repeats, lines, _ = base(text)
        punct = len(re.findall(r"[!-/:-@\[-`{-~]", text))
        m = max(n, 1)
        values = [chars * 100 // m, symbols * 1000 // m, punct * 1000 // m, max(dups - 1, 0) * 1000 // max(len(lines), 4)]
        key = (lang or "", source or "")
        measured.append((doc_id, key, values, (n, chars, symbols, dups, repeats)))
        if n >= 10 and 100 * repeats <= 20 * n:
            for wider in (key, key[:1], ()):
                groups[wider].append(values)
    spec = list(quality_rules.MEASURES.values())
    out = Counter()
    for doc_id, key, values, counts in measured:
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        inside, group = True, next((groups[x] for x in (key, key[:1], ()) if len(groups[x]) >= quality_rules.MIN_GROUP), [])
        if group:
            for k, (_, width, slack, both) in enumerate(spec):
                edges = sorted(edge(v[k]) for v in group)
                q1, q3 = edges[-(-len(edges) // 4) - 1], edges[-(-3 * len(edges) // 4) - 1]
                reach = width * (q3 - q1) + slack
                high = q3 + reach
                if q1 == q3:
                    steps = [(a, b) for a, b in zip(sorted(set(edges)), sorted(set(edges))[1:]) if b > q3 + slack and 2 * b > 3 * a]
                    high = sum(steps[0]) // 2 if steps else quality_rules.NO_FENCE
                inside &= values[k] <= high and (not both or values[k] >= q1 - reach)
        out[doc_id, *counts, failed, not failed and inside] += 1
    return out


def test_against_brute_force(edge_docs, edge_rows):
    assert Counter(map(tuple, quality_rules.quality(edge_docs).collect())) == brute(edge_rows)


def test_many_groups_are_joined_by_a_shuffle(edge_docs):
    rows = quality_rules.measured(edge_docs, ["doc_id"]).cache()
    columns = ["own.doc_id", "base_failed", "kept"]
    few, many = (Counter(map(tuple, quality_rules._judged(rows, n).select(*columns).collect())) for n in (100, 0))
    assert few == many


def test_filter_keeps_columns(edge_docs, edge_rows):
    left = quality_rules.filter_quality(edge_docs)
    assert left.columns == edge_docs.columns
    kept = Counter()
    for key, n in brute(edge_rows).items():
        if key[-1]:
            kept[key[0]] += n
    assert Counter(r.doc_id for r in left.select("doc_id").collect()) == kept


def test_empty_table(no_docs):
    assert quality_rules.quality(no_docs).count() == 0
    assert quality_rules.filter_quality(no_docs).count() == 0


def test_few_rows_have_no_fences(spark):
    docs = spark.createDataFrame([(1, "## ** $$ " * 2 + "a b c d e f g h i j", "en", "web")], "doc_id long, text string, lang string, source string")
    assert quality_rules.quality(docs).first().kept


def test_fences_drop_a_mode_of_symbols_and_keep_single_ones(spark):
    words = "these are plain words of a clean text in prose".split()
    clean = [(k, " ".join(words), "en", "web") for k in range(60)]
    single = [(100, " ".join([*words[:-1], "$5"]), "en", "web"), (101, " ".join([*words[:-1], '"prose"']), "en", "web")]
    # 0.3 to 0.5 symbols a word, and the same share of other marks
    junk = [(200 + k, " ".join([*words, *(c for c in "#*$%&|<>"[:n])]), "en", "web") for k, n in enumerate((5, 6, 8))]
    junk += [(300, " ".join([*words, *"(),;:!?"]), "en", "web")]
    docs = spark.createDataFrame([*clean, *single, *junk], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality_rules.filter_quality(docs).select("doc_id").collect()} == {k for k, *_ in [*clean, *single]}


def test_small_groups_have_the_fences_of_their_language_then_of_all(spark):
    words = "these are plain words of a clean text in prose"
    junk = words + " # * $ % & |"
    rows = [(k, words, "en", "web") for k in range(60)] + [(100, junk, "en", "rare"), (101, words, "en", "rare"), (102, junk, "xx", "rare"), (103, words, "xx", None), (104, junk, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality_rules.filter_quality(docs).select("doc_id").collect()} == {*range(60), 101, 103}


def fences_of(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows = quality_rules.measured(df, ["doc_id"])
    return {r["source"]: [f["high"] for f in r["fences"]] for r in quality_rules.fences(rows).collect()}


def test_fences_follow_the_usual_shares_of_a_source(spark, monkeypatch):
    """Of three sources without symbols in most texts, each has its own junk or none; the fence stands between, and half the slack changes nothing."""
    words = ("these are plain words of a clean text in prose " * 4).split()
    words = [f"{w}{k}" for k, w in enumerate(words)]
    rows = [(k, " ".join(words), "en", source) for source in ("a", "b", "c") for k in range(60)]
    rows += [(100 + k, " ".join(words + [f"#{i}" for i in range(20)]), "en", "a") for k in range(4)] + [(200 + k, " ".join(words + [f"#{i}" for i in range(200)]), "en", "b") for k in range(4)]
    rows += [(300 + k, " ".join(words + [f"#{i}" for i in range(k)]), "en", "c") for k in range(1, 14)]  # a body of its own, without a gap
    found = fences_of(spark, rows)
    symbols = {source: high[1] for source, high in found.items()}
    assert 0 < symbols["a"] < 20 * 1000 // 60 and symbols["a"] < symbols["b"] < 200 * 1000 // 240 and symbols["c"] == quality_rules.NO_FENCE
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.filter_quality(df).select("doc_id").collect()}
    monkeypatch.setitem(quality_rules.MEASURES, "symbols", (*quality_rules.MEASURES["symbols"][:2], 50, False))
    assert kept == {r.doc_id for r in quality_rules.filter_quality(df).select("doc_id").collect()} == {*range(60), *range(301, 314)}


def test_oracle_is_registered():
    assert "op6_quality_rules" in ORACLES
