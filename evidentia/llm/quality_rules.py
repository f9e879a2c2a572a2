"""Quality rules with adaptive thresholds, by DataFrame functions only.

Each text is measured once. For each language and source, each measure gets a mergeable quantile sketch: counts of
log-linear buckets (exact below 64, then 64 to an octave), so merging is adding and the result doesn't depend on
the order of rows or tasks; texts that fail the base aren't in it. Fences replace fixed cutoffs. Where a group's quartiles differ, they lie some quartile distances beyond
them. Where they are equal (most texts have no symbol and no copied line), the upper fence stands in the middle of the first empty stretch of the group's own sketch: from
the quartile up, the next occupied bucket still belongs to the body if it is within the measure's slack or at most half as large again as the one before, and the first that isn't
begins another mode; without such a stretch there is no fence. The measured rows are then
joined with the fences of their language and source and filtered. A group under MIN_GROUP rows has too few for quartiles: it gets
the fences of its language's merged sketch, and where that is too small, too, those of the whole table's; a table under MIN_GROUP
rows has none. Rows aren't shuffled for that, only sketches are, unless there are very many groups.

Rows: one per input row. Null text has no words, and fails as all texts of few words do. Null language or source is a
group value of its own, shared with the empty string. Nothing is compared between rows but sketches, so ties and repeated rows
need no rule. Very long texts are measured whole, as arrays of their words. Other columns are kept by `filter_quality` and ignored by `quality`. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.llm.common import SPACE, space_words, text_or_empty
from evidentia.storage import materialize

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW_WORDS = 10, 20, 5
MIN_GROUP = 50
#: Where a group has no fence.
NO_FENCE = 1 << 62
#: Languages and sources whose fences are broadcast (about 150 bytes each); more of them are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Measures as integers: expression over the counts, the fences' width in quartile distances, the slack and whether there is a lower fence. The slack is the measure's
#: own step: one symbol or a pair of marks in the shortest text that passes the base (10 words), two copied lines of eight.
MEASURES = {
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 6, 150, True),
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", 6, 100, False),
    "punctuation": ("n_punct * 1000 div greatest(n_words, 1)", 6, 200, False),
    "copied_lines": ("greatest(n_dup_lines - 1, 0) * 1000 div greatest(n_lines, 4)", 6, 250, False),
}


def _repeated_words(words: Column, n: Column, grams: Column) -> Column:
    """Words inside windows found twice or more: hashes tell whether there are any; then windows are compared as strings."""
    width = WINDOW_WORDS
    windows = F.sort_array(
        F.transform(F.sequence(F.lit(0), n - width), lambda i: F.struct(F.get(grams, i).alias("h"), F.concat_ws(" ", F.slice(words, i + 1, width)).alias("w"), i.alias("i")))
    )

    def places(sorted_windows: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(sorted_windows, a)["w"] == F.get(sorted_windows, b)["w"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), n - width), lambda k: same(k, k + 1) | ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))))
        return F.sort_array(F.transform(twice, lambda k: F.get(sorted_windows, k)["i"]))

    start = F.struct(F.lit(0).alias("sum"), F.lit(-width).alias("last"))
    # bound once by a one-element array, so that the sort isn't repeated for each use
    at = F.get(F.transform(F.array(windows), places), 0)
    covered = F.aggregate(at, start, lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(width), i - acc["last"])).alias("sum"), i.alias("last")))
    return covered["sum"]


def measured(docs: DataFrame, own: list[str]) -> DataFrame:
    """The columns `own` of every row as a struct `own`, with lang, source (no nulls) and the counts."""
    key = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in own]).alias("own"), key("lang"), key("source"), text_or_empty().alias("text"))
    text, words, lines, grams, n = (F.col(x) for x in ("text", "words", "lines", "grams", "n"))
    rows = rows.select("own", "lang", "source", "text", space_words(text).alias("words"), F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"))
    rows = rows.select("*", F.size(words).alias("n"))
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW_WORDS), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW_WORDS)]))
    rows = rows.select("*", F.when(n >= WINDOW_WORDS, hashes).otherwise(F.array().cast("array<bigint>")).alias("grams"))
    any_twice = F.size(F.array_distinct(grams)) < F.size(grams)
    return rows.select(
        "own",
        "lang",
        "source",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[!-/:-@\[-`{-~]+", ""))).cast("long").alias("n_punct"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(any_twice, _repeated_words(words, n, grams)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _edge(value: Column) -> Column:
    """The lower edge of a value's bucket."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _measures() -> Column:
    """The measures of texts that have words, as an array of (measure, value)."""
    return F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(m[0]).cast("long").alias("value")) for k, m in enumerate(MEASURES.values())])


def fences(rows: DataFrame) -> DataFrame:
    """Language and source with their fences, as arrays in the order of MEASURES, from the sketches of measured rows."""
    values = rows.where(~_failed()).select("lang", "source", F.explode(_measures()).alias("m")).select("lang", "source", "m.measure", "m.value")
    own = materialize(values.groupBy("lang", "source", "measure", _edge(F.col("value")).alias("edge")).agg(F.count("*").alias("n")), "sketches")
    # sketches merge by adding: of the group itself, of its language, of the whole table
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.alias("of_lang"), source.alias("of_source"))
    levels = F.inline(F.array(level(0, F.col("lang"), F.col("source")), level(1, F.col("lang"), F.lit("")), level(2, F.lit(""), F.lit(""))))
    merged_keys = ["level", "of_lang", "of_source"]
    keys = [*merged_keys, "measure"]
    sketch = own.select(levels, "measure", "edge", "n").groupBy(*keys, "edge").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys)
    so_far = F.sum("n").over(group.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0))
    at = sketch.select(*keys, "edge", so_far.alias("so_far"), F.sum("n").over(group).alias("total"))
    quarter = lambda q: F.min(F.when(F.col("so_far") * 4 >= F.col("total") * q, F.col("edge"))).over(group)
    of_measure = lambda k: F.element_at(F.array(*[F.lit(m[k]) for m in MEASURES.values()]), F.col("measure") + 1)
    at = at.withColumns({"q1": quarter(1), "q3": quarter(3), "slack": of_measure(2), "before": F.lag("edge").over(group.orderBy("edge"))})
    # the first bucket that isn't of the body, with the last that is
    apart = (F.col("edge") > F.col("q3") + F.col("slack")) & (2 * F.col("edge") > 3 * F.col("before"))
    edges = at.groupBy(*keys).agg(*[F.first(x).alias(x) for x in ("q1", "q3", "slack", "total")], F.min(F.when(apart, F.struct("edge", "before"))).alias("stretch"))
    reach = of_measure(1) * (F.col("q3") - F.col("q1")) + F.col("slack")
    middle = F.floor((F.col("stretch.edge") + F.col("stretch.before")) / 2).cast("long")
    high = F.when(F.col("q3") > F.col("q1"), F.col("q3") + reach).otherwise(F.coalesce(middle, F.lit(NO_FENCE)))
    fenced = edges.where(F.col("total") >= MIN_GROUP).select(*keys, (F.col("q1") - reach).alias("low"), high.alias("high"))
    merged = fenced.groupBy(*merged_keys).agg(F.sort_array(F.collect_list(F.struct("measure", "low", "high"))).alias("fences"))
    groups = own.select("lang", "source").distinct().select("lang", "source", levels)
    return groups.join(merged, merged_keys).groupBy("lang", "source").agg(F.min_by("fences", "level").alias("fences"))


def _judged(rows: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Measured rows with base_failed and kept."""
    failed = _failed()
    inside = F.lit(True)
    for k, (formula, _, _, both) in enumerate(MEASURES.values()):
        value, fence = F.expr(formula), F.get("fences", F.lit(k))
        inside = inside & (value <= fence["high"])
        if both:
            inside = inside & (value >= fence["low"])
    found = materialize(fences(rows), "fences")
    # few groups, as counted here, go to the rows; beyond that the rows of a large source are split by the skew join
    joined = rows.join(F.broadcast(found) if found.count() <= broadcast_groups else found, ["lang", "source"], "left")
    kept = F.when(failed, F.lit(False)).when(F.col("fences").isNull(), F.lit(True)).otherwise(inside)
    return joined.withColumns({"base_failed": failed, "kept": kept})


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the counts, base_failed and kept of every row; docs needs doc_id, text, lang and source."""
    rows = materialize(measured(docs, ["doc_id"]), "measured")
    return _judged(rows).select("own.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    rows = materialize(measured(docs, docs.columns), "measured")
    return _judged(rows).where("kept").select("own.*")
