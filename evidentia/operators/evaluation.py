"""Checks of answers against their evidence, scores of an evaluation, and gates for new evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text as t

#: Fixed value: least token similarity of a cited title and the real one.
TITLE_MATCH = 0.7


def cited(answers: DataFrame, answer: str, n_items: str) -> DataFrame:
    """`answers` with the numbers cited, and those that no evidence item has."""
    numbers = t.citations(F.col(answer))
    return answers.withColumn("citations", numbers).withColumn("invented", F.filter("citations", lambda x: (x < 1) | (x > F.col(n_items))))


def claim_checks(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """A row for each sentence that cites something: its number, citations, and whether it needs a limiting word."""
    rows = answers.select(key, F.posexplode(t.claims(F.col(answer))).alias("claim_no", "claim"))
    return rows.withColumns({"citations": t.citations(F.col("claim")), "needs_hedge": t.needs_hedge(F.col("claim"))})


def answer_scores(results: DataFrame) -> DataFrame:
    """E, V and D of each answer and their product.

    results: question_id, refused (boolean), must_cite and cited (arrays of ids), n_unsupported, n_unhedged.
    E: a wanted id is cited, or nothing is wanted and it was refused. V: nothing unsupported. D: no percentage without a limiting word.
    """
    wanted = F.size("must_cite") > 0
    e = F.when(wanted, F.size(F.array_intersect("must_cite", "cited")) > 0).otherwise(F.col("refused"))
    scored = results.withColumns({"e": e.cast("int"), "v": (F.col("n_unsupported") == 0).cast("int"), "d": (F.col("n_unhedged") == 0).cast("int")})
    return scored.withColumn("score", F.col("e") * F.col("v") * F.col("d"))


def mean_scores(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), *[F.round(F.avg(x), 4).alias(x) for x in ("e", "v", "d", "score")])


def title_gate(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """`entries` (url, title) with the real title of their paper, their similarity, and whether they pass."""
    asked = entries.withColumn("paper_id", t.paper_id(F.col("url")))
    joined = asked.join(titles.select("paper_id", F.col("title").alias("real_title")), "paper_id", "left")
    similarity = t.set_jaccard(t.title_tokens(F.col("title")), t.title_tokens(F.col("real_title")))
    return joined.withColumn("similarity", F.round(similarity, 4)).withColumn("passes", F.coalesce(F.col("similarity") >= TITLE_MATCH, F.lit(False)))


def json_reply(reply: Column, schema: str) -> Column:
    """A reply as JSON, or the first object in braces inside it; null if neither can be read."""
    inner = F.regexp_extract(reply, r"(\{[^{}]*\})", 1)
    return F.coalesce(F.from_json(F.when(F.btrim(reply).startswith("{"), reply), schema), F.from_json(F.nullif(inner, F.lit("")), schema))


def verify_rounds(answer: str, pack: list[str], supported: Callable[[str, list[str]], bool], rewrite: Callable[[str, list[str]], str], rounds: int = 2) -> tuple[str, list[str], int]:
    """One answer checked by an injected judge: unsupported sentences are rewritten for up to `rounds` rounds, then marked.

    A conversation is one small document, so this runs where it is called; batches go through claim_checks.
    """
    import re

    sentences = lambda x: [s.strip() for s in re.split(t.CLAIM_SPLIT, x) if re.search(r"\[\d{1,3}\]", s)]
    bad: list[str] = []
    for done in range(rounds):
        bad = [s for s in dict.fromkeys(sentences(answer)) if not supported(s, pack)]
        if not bad:
            return answer, [], done
        answer = rewrite(answer, bad)
    bad = [s for s in dict.fromkeys(sentences(answer)) if not supported(s, pack)]
    for sentence in bad:
        answer = answer.replace(sentence, f"⚠️{sentence}")
    return answer, bad, rounds


def question_items(assertions: DataFrame, human_levels: list[str], least: int = 2) -> DataFrame:
    """Questions for an evaluation: a component and family with enough human evidence must be answered with it; one without any evidence of its own but with that of others must be refused.

    assertions: assertion_id, ingredient_id, family, level.
    """
    human = F.col("level").isin(human_levels)
    by_pair = assertions.groupBy("ingredient_id", "family").agg(F.array_sort(F.collect_set(F.when(human, F.col("assertion_id")))).alias("must_cite"))
    checks = by_pair.where(F.size("must_cite") >= least).select("ingredient_id", "family", "must_cite", F.lit("fact_check").alias("kind"))
    weak = by_pair.where(F.size("must_cite") == 0).select("ingredient_id", "family")
    refusals = weak.join(checks.select("ingredient_id").distinct(), "ingredient_id", "left_anti").select("ingredient_id", "family", F.array().cast("array<bigint>").alias("must_cite"), F.lit("refusal").alias("kind"))
    return checks.unionByName(refusals)


def exclusive_quartiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, q1, q2, q3 by the (n + 1) q rule; null under two values. Equal values are counted first, so only different ones meet."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(key)
    placed = counted.select(key, F.col(value).alias("v"), F.sum("n").over(own.orderBy(value)).alias("upto"), F.sum("n").over(own).alias("total"))

    def at(q: int) -> Column:
        place = (F.col("total") + 1) * q
        low = F.least(F.greatest(F.floor(place / 4), F.lit(1)), F.col("total") - 1)
        first, second = (F.min(F.when(F.col("upto") >= x, F.col("v"))) for x in (low, low + 1))
        return F.when(F.max("total") >= 2, first + (second - first) * F.max((place - low * 4) / 4.0))

    return placed.groupBy(key).agg(*[at(q).alias(f"q{q}") for q in (1, 2, 3)])
