"""Matching names to a register: tiers of ever looser keys, aliases in texts, evidence packs, ambiguity and votes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.functions.text import collapse


def unique_keys(register: DataFrame, key: Column, value: str) -> DataFrame:
    """key, value of the keys that stand for one value only."""
    return register.select(key.alias("key"), F.col(value).alias("value")).where("key is not null and key <> ''").groupBy("key").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n")).where("n = 1").drop("n")


def match_tiers(names: DataFrame, name: str, tiers: list[tuple[str, Column, DataFrame]]) -> DataFrame:
    """`names` with matched and via: the value of the first tier that knows the name, and which tier that was.

    tiers: (tag, key of the name, table of key and value). A tier's table has each key once.
    """
    matched, via = [], []
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    found = distinct
    for k, (tag, key, table) in enumerate(tiers):
        own = table.select(F.col("key").alias(f"_key{k}"), F.col("value").alias(f"_value{k}"))
        found = found.join(own, key == F.col(f"_key{k}"), "left")
        matched.append(F.col(f"_value{k}"))
        via.append(F.when(F.col(f"_value{k}").isNotNull(), F.lit(tag)))
    chosen = found.select(name, F.coalesce(*matched).alias("matched"), F.coalesce(*via).alias("via"))
    return names.join(chosen, name, "left")


def standard_tiers(register: DataFrame, name: str, value: str, column: str, aliases: DataFrame | None = None) -> list[tuple[str, Column, DataFrame]]:
    """Exact upper case, then collapsed form, then aliases; only keys that stand for one value."""
    tiers = [
        ("exact", F.upper(F.btrim(F.col(column))), unique_keys(register, F.upper(F.btrim(F.col(name))), value)),
        ("collapsed", collapse(F.col(column)), unique_keys(register, collapse(F.col(name)), value)),
    ]
    if aliases is not None:
        tiers.append(("alias", F.upper(F.btrim(F.col(column))), unique_keys(aliases, F.upper(F.btrim(F.col("alias"))), "value")))
    return tiers


def fuzzy_rank(query: Column, name: Column) -> Column:
    """0 for equal names, 1 for a prefix, 2 for a part, null for none; then shorter names and smaller ids are better."""
    q, n = F.upper(query), F.upper(name)
    return F.when(q == n, 0).when(n.startswith(q), 1).when(n.contains(q), 2)


def ambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, and how many."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; none where the two most frequent ones are equally frequent."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("votes"))
    ranked = counted.withColumn("place", F.rank().over(Window.partitionBy(key).orderBy(F.desc("votes"))))
    first = ranked.where("place = 1").groupBy(key).agg(F.min(value).alias(value), F.max("votes").alias("votes"), F.count("*").alias("n"))
    return first.where("n = 1").drop("n")


#: Characters of all different phrases together, up to which every task gets an automaton of them (some 50 bytes a character); more phrases meet by hashes.
MOST_PHRASE_CHARS = 2_000_000
_AUTOMATON: dict[str, object] = {}
#: What parts words, as in the expressions of the other way.
SPACES = r"[ \t\n\x0b\f\r]+"


def phrases_in_texts(texts: DataFrame, phrases: DataFrame, width: int = 12, by_words: bool = False, most_chars: int = MOST_PHRASE_CHARS) -> DataFrame:
    """text_id, phrase_id of every phrase that stands in a text; texts: text_id, text; phrases: phrase_id, phrase.

    A phrase stands in a text as a run of characters, or (by_words) of whole words, whatever white space parts them. Where all
    different phrases have at most most_chars characters, an automaton of them (a trie with failure links) goes to the tasks, which read each text once and shuffle nothing;
    beyond that, phrases and texts meet by hashes of their beginnings. Empty phrases stand nowhere.
    """
    phrase = F.coalesce(F.col("phrase"), F.lit(""))
    if by_words:
        phrase = F.array_join(F.filter(F.split(phrase, r"\s+"), lambda x: x != ""), " ")
    asked = phrases.select("phrase_id", phrase.alias("phrase")).where("phrase <> ''")
    different = asked.select("phrase").distinct()
    if (different.agg(F.sum(F.length("phrase"))).first()[0] or 0) > most_chars:
        return _phrases_by_hashes(texts, phrases, width, by_words)
    listed = [r["phrase"] for r in different.collect()]  # at most most_chars characters
    numbered = texts.sparkSession.createDataFrame(list(enumerate(listed)), "number long, phrase string")
    found = texts.select("text_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([texts.schema["text_id"], T.StructField("number", T.LongType())])
    met = found.mapInArrow(_scan(texts.sparkSession.sparkContext.broadcast(listed), by_words), schema)
    return met.join(F.broadcast(numbered), "number").join(asked, "phrase").select("text_id", "phrase_id").distinct()


def _automaton(name: str, phrases: list[str]):
    """The automaton of phrases, which are numbered in order; a Python worker keeps the last one."""
    import ahocorasick

    if name not in _AUTOMATON:
        built = ahocorasick.Automaton()
        for number, phrase in enumerate(phrases):
            built.add_word(phrase, number)
        built.make_automaton()
        _AUTOMATON.clear()
        _AUTOMATON[name] = built
    return _AUTOMATON[name]


def _scan(phrases, by_words: bool):
    """Pairs of a text and the number of a phrase in it; words are parted by one space, and spaces stand at both ends."""
    name = uuid.uuid4().hex
    spaced = lambda text: f" {' '.join(filter(None, re.split(SPACES, text)))} " if by_words else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, [spaced(x) for x in phrases.value])
        for batch in batches:
            rows, numbers = [], []
            for row, text in enumerate(batch.column(1).to_pylist() if len(automaton) else []):
                own = {number for _, number in automaton.iter(spaced(text))}
                rows += [row] * len(own)
                numbers += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int64())], names=["text_id", "number"])

    return run


def _phrases_by_hashes(texts: DataFrame, phrases: DataFrame, width: int, by_words: bool) -> DataFrame:
    """Both sides meet by hashes of their first `width` units, so no text is compared with phrases that don't begin in it; shorter phrases meet
    by all of their units. Only ids, places and hashes are shuffled; what meets is confirmed on the text itself.
    """
    held = lambda text: F.coalesce(text, F.lit(""))
    units = (lambda text: F.filter(F.split(held(text), r"\s+"), lambda x: x != "")) if by_words else (lambda text: F.filter(F.split(held(text), ""), lambda x: x != ""))
    start = lambda own, at, k: F.xxhash64(F.array_join(F.slice(own, at, k), " " if by_words else ""))
    asked = phrases.select("phrase_id", units(F.col("phrase")).alias("p_units")).withColumn("n", F.size("p_units")).where("n > 0")
    asked = asked.withColumn("w", F.least(F.col("n"), F.lit(width)))
    asked = asked.withColumn("key", start(F.col("p_units"), F.lit(1), F.col("w")))
    split = texts.select("text_id", units(F.col("text")).alias("t_units")).where(F.size("t_units") > 0)
    size = F.size("t_units")

    def places(k: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda at: F.struct(at.alias("at"), start(F.col("t_units"), at, k).alias("key")))
        return F.when(size >= k, found).otherwise(F.array().cast("array<struct<at:int,key:bigint>>"))

    widths = sorted(r.w for r in asked.select("w").distinct().collect())  # at most `width` numbers
    every = F.concat(*[places(k) for k in widths or [width]])
    met = split.select("text_id", F.explode(every).alias("p")).select("text_id", "p.at", "p.key").join(asked.select("phrase_id", "key"), "key")
    both = met.join(split, "text_id").join(asked.select("phrase_id", "p_units", "n"), "phrase_id")
    return both.where(F.slice("t_units", F.col("at"), F.col("n")) == F.col("p_units")).select("text_id", "phrase_id").distinct()


def evidence_pack(hits: DataFrame, evidence: DataFrame, max_entities: int = 3, max_items: int = 8) -> DataFrame:
    """Numbered evidence of each question: its best entities (by stage, then longer names, then id), then their evidence by id.

    hits: question_id, entity_id, stage, length; stages above 2 count only where earlier ones found nothing.
    evidence: entity_id, evidence_id, text.
    """
    early = F.max(F.when(F.col("stage") <= 2, 1).otherwise(0)).over(Window.partitionBy("question_id"))
    usable = hits.withColumn("early", early).where("stage <= 2 or early = 0")
    best = usable.groupBy("question_id", "entity_id").agg(F.min(F.struct("stage", (-F.col("length")).alias("shorter"))).alias("order"))
    by_order = F.row_number().over(Window.partitionBy("question_id").orderBy("order", "entity_id"))
    chosen = best.withColumn("entity_rank", by_order).where(F.col("entity_rank") <= max_entities)
    number = F.row_number().over(Window.partitionBy("question_id").orderBy("entity_rank", "evidence_id"))
    return chosen.join(evidence, "entity_id").withColumn("item", number).where(F.col("item") <= max_items).select("question_id", "item", "entity_id", "evidence_id", "text")


def id_gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Runs of missing numbers between the least and the greatest of each key: first, last, and how many."""
    following = F.lead(number).over(Window.partitionBy(key).orderBy(number))
    gaps = rows.select(key, number).distinct().withColumn("following", following).where(F.col("following") - F.col(number) > 1)
    return gaps.select(key, (F.col(number) + 1).alias("first_missing"), (F.col("following") - 1).alias("last_missing"), (F.col("following") - F.col(number) - 1).alias("n_missing"))


def ordered_text(links: DataFrame, key: str, value: str, position: str, separator: str = "、") -> DataFrame:
    """The values of each key in the order of their positions (nulls last), joined into one string; repeated values once."""
    first = links.groupBy(key, value).agg(F.min(F.coalesce(F.col(position), F.lit(2**31 - 1))).alias("place"))
    listed = F.sort_array(F.collect_list(F.struct("place", value)))
    return first.groupBy(key).agg(F.array_join(listed[value], separator).alias("text"))


def decode(lists: DataFrame, key: str, words: str, register: DataFrame, name: str, value: str) -> DataFrame:
    """A row for each word of a pasted list: its place and whether it is a hit (one value), a doubt (several) or a miss."""
    known = register.select(collapse(F.col(name)).alias("_key"), F.col(value).alias("_value")).groupBy("_key").agg(F.count_distinct("_value").alias("n_values"), F.min("_value").alias("value"))
    rows = lists.select(key, F.posexplode(words).alias("place", "word")).withColumn("_key", collapse(F.col("word")))
    status = F.when(F.col("n_values") == 1, "hit").when(F.col("n_values") > 1, "doubt").otherwise("miss")
    return rows.join(known, "_key", "left").select(key, "place", "word", status.alias("status"), F.when(F.col("n_values") == 1, F.col("value")).alias("value"))


def search_all(query: str, k: int, **tables: tuple[DataFrame, str, str]) -> DataFrame:
    """The k best names of each table: kind, id, name and rank; better are equal names, then beginnings, shorter names, smaller ids."""
    found = None
    for kind, (rows, key, name) in tables.items():
        order = fuzzy_rank(F.lit(query), F.col(name))
        own = rows.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("name"), order.alias("tier")).where("tier is not null")
        own = own.orderBy("tier", F.length("name"), "id").limit(k)
        found = own if found is None else found.unionByName(own)
    return found


def merged_names(register: DataFrame, name: Column, key: str) -> DataFrame:
    """key, keeper: the smallest key that has the same clean name. Rows whose clean name is empty keep themselves."""
    named = register.select(F.col(key), name.alias("_name"))
    first = named.where("_name <> ''").groupBy("_name").agg(F.min(key).alias("keeper"))
    return named.join(first, "_name", "left").select(key, F.coalesce("keeper", key).alias("keeper"))
