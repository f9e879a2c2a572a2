"""Expressions over the texts of the given tables: lines of documents, whole texts, turns of conversations, addresses of pages, dates of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as t
from evidentia.operators import matching, retrieval, stubs
from evidentia.plans.detail_queries import CELLS, LISTS, NAMES, NOTES, PRICES
from evidentia.plans.queries import query
from evidentia.sources import domain, ranges
from evidentia.sources.domain import table

#: Texts that the tables don't have, as rows of their own.
ADDED = [*NAMES, *CELLS, *LISTS, *PRICES, *NOTES, "理肤泉 La Roche-Posay", "Rose (A/B) [x/y]", "n\U0001f600é", "eau, AQUA - water"]
ALCOHOL = "ALCOHOL"


def lines(spark, sf: str) -> DataFrame:
    """doc_id, line_no and line of every line of every document, and the added texts under -1. (ß has no upper case that all engines agree on, and is written ss.)"""
    parts = F.posexplode(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("ss")), "\n")).alias("line_no", "line")
    rows = table(spark, sf, "documents").select("doc_id", "source", parts)
    added = spark.createDataFrame([(-1, "理肤泉", k, x) for k, x in enumerate(ADDED)], "doc_id long, source string, line_no int, line string")
    return rows.select("doc_id", "source", "line_no", "line").unionByName(added)


@query
def names_in_lines(spark, sf):
    line, cn = F.col("line"), F.col("source")
    joined = lambda x, by: F.array_join(x, by)
    return lines(spark, sf).select(
        "doc_id",
        "line_no",
        t.bare_name(line).alias("bare"),
        t.is_alcohol(line, cn).alias("alcohol"),
        t.is_acid(line, cn).alias("acid"),
        t.is_fragrance(line, cn).alias("fragrance"),
        t.canonical_water(line).alias("water"),
        t.stem(line).alias("stem"),
        t.brand_group(line).alias("brand_group"),
        t.brand_head(line).alias("brand_head"),
        t.same_brand(line, cn).alias("same_brand"),
        t.component_key(line, cn, F.lit(None).cast("string")).alias("component_key"),
        joined(t.official_keys(line), "|").alias("official_keys"),
        t.mixture_part(line).alias("mixture_part"),
        t.mixture_word(line).alias("mixture_word"),
        t.slash_in_parentheses(line).alias("slash_inside"),
        t.collapse(line).alias("collapsed"),
    )


@query
def notes_in_lines(spark, sf):
    line = F.col("line")
    joined = lambda x, by: F.array_join(x, by)
    stated = t.stated_phrases(line, F.col("source"), "其他")
    return lines(spark, sf).select(
        "doc_id",
        "line_no",
        joined(t.latin_parts(line), "|").alias("latin"),
        joined(stated["phrases"], "|").alias("phrases"),
        stated["skipped"].alias("skipped"),
        joined(t.effect_phrases(line), "|").alias("effects"),
        joined(t.list_tokens(line), "|").alias("listed"),
        t.marked_price(line).alias("price"),
        t.percent_range(line)["low"].alias("low"),
        t.percent_range(line)["high"].alias("high"),
        t.paper_id(line).alias("paper"),
        joined(t.citations(line).cast("array<string>"), ",").alias("cited"),
        t.needs_hedge(line).alias("needs_hedge"),
        t.profile_key(line).alias("key"),
        t.plain_number(F.length(line) / F.lit(8.0)).alias("number"),
    )


@query
def texts_unwrapped(spark, sf):
    """Texts as cells of a table whose lines were wrapped."""
    cell = t.join_wrapped(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.length(cell).alias("length"), F.md5(cell).alias("digest"))


@query
def streams_of_turns(spark, sf):
    """Conversations as streams of server-sent events, one a turn, read back; and the JSON object in each turn's answer."""
    turns = table(spark, sf, "conversations").where("text is not null")
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.col("text").alias("part"))))
    streams = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", event.alias("event")))).alias("events"))
    text = F.concat(F.array_join("events.event", "\n\n"), F.lit("\n\n: comment\n\ndata: broken\n\ndata: [DONE]\n\n"))
    parts = t.stream_parts(text, "part")
    read = streams.select("conv_id", F.size(parts).alias("n_parts"), F.md5(F.array_join(parts, "|")).alias("digest"))
    answer = F.concat("text", F.lit(' {"winner": "'), F.col("role"), F.lit('", "turn": '), F.col("turn").cast("string"), F.lit("} so far"))
    told = turns.groupBy("conv_id").agg(F.count_if(t.answer_field(answer, "winner") == "user").alias("n_user"), F.sum(t.answer_field(answer, "turn").cast("long")).alias("turns"))
    return read.join(told, "conv_id")


@query
def slugs_of_hosts(spark, sf):
    """Addresses of pages as the sitemap of each host, and the numbers of its English pages."""
    pages = table(spark, sf, "pages").where("url is not null")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    sitemap = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<url><loc> "), F.col("url"), F.lit("</loc></url>")))), "\n")
    maps = pages.groupBy(host.alias("host")).agg(sitemap.alias("sitemap"))
    return maps.select("host", F.array_join(F.array_sort(t.page_slugs(F.col("sitemap"), r"/en/(\d+)", "page=")), ",").alias("slugs"))


@query
def dates_as_written(spark, sf):
    """Dates of orders in forms that are read and in some that aren't."""
    forms = ["yyyy-MM-dd", "yyyy/M/d", "yyyyMMdd", "dd.MM.yyyy", "yyyy-M-d"]
    key = F.col("o_orderkey") % len(forms)
    written = F.coalesce(*[F.when(key == k, F.date_format("o_orderdate", form)) for k, form in enumerate(forms)])
    return table(spark, sf, "orders").select("o_orderkey", t.safe_date(F.concat(F.lit(" "), written, F.lit(" "))).cast("string").alias("day"))


@query
def reports_of_parts(spark, sf):
    """What an evaluation's category says, as reports of parts by type."""
    tiers = {"STANDARD": "人体功效评价试验", "ECONOMY": "消费者使用测试", "MEDIUM": "实验室试验", "PROMO": "研究数据", "LARGE": "文献资料"}
    category = F.element_at(F.create_map(*[F.lit(x) for pair in tiers.items() for x in pair]), F.col("p_type"))
    report = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")))
    return table(spark, sf, "part").select("p_partkey", t.evaluation_tier(category).alias("tier"), t.page_name(F.concat(F.lit('"'), F.col("p_name"), F.lit("&amp;&nbsp;"), F.col("p_brand"), F.lit(" (5 %)"))).alias("name"), report.alias("report"))


@query
def question_components(spark, sf):
    """Turns of conversations as questions that mention a part in one of four ways or not at all: the components that each asks about, by stage."""
    part, k = table(spark, sf, "part"), F.col("conv_id") + F.col("turn")
    components = part.groupBy("p_name").agg(F.min("p_partkey").alias("ingredient_id")).select("ingredient_id", F.concat(F.lit("料"), "p_name").alias("cn_name"), F.col("p_name").alias("inci_name"))
    aliases = components.select(F.concat(F.lit("old "), "inci_name").alias("alias"), "ingredient_id", F.col("ingredient_id").alias("place"))
    turns = table(spark, sf, "conversations").where("text is not null").withColumn("p_partkey", (F.col("conv_id") * 7 + F.col("turn")) % 200)
    name = F.col("p_name")
    mention = F.when(k % 5 == 0, F.concat(F.lit(" Old "), name)).when(k % 5 == 1, F.concat(F.lit(" 料"), name)).when(k % 5 == 2, F.concat(F.lit(" "), F.upper(name))).when(k % 5 == 3, F.concat(F.lit(" "), F.substring(name, 2, 4))).otherwise("")
    questions = turns.join(part.select("p_partkey", "p_name"), "p_partkey").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat("text", mention).alias("question"))
    return retrieval.question_components(questions, aliases, components)


@query
def question_evidence(spark, sf):
    """The numbered evidence of each of these questions: the assertions of its components, by stage."""
    asked = question_components(spark, sf)
    hits = asked.select("question_id", F.col("ingredient_id").alias("entity_id"), F.col("rank").alias("stage"), F.lit(0).alias("length")).where("stage <= 2")
    facts = domain.assertions(spark, sf).select(F.col("ingredient_id").alias("entity_id"), F.col("assertion_id").alias("evidence_id"), F.col("effect").alias("text"))
    return matching.evidence_pack(hits, facts)


@query
def stub_components(spark, sf):
    """Names of parts, their brands and sources of documents looked up among the components, and created where there is none."""
    register = domain.components(spark, sf).select("ingredient_id", "inci_name", "cn_name")
    part = table(spark, sf, "part")
    names = part.select(F.explode(F.array("p_name", "p_brand", F.concat(F.lit("成分"), F.col("p_partkey").cast("string")))).alias("name"))
    names = names.unionByName(table(spark, sf, "documents").select(F.col("source").alias("name")))
    return stubs.find_or_create(names, register)[1]


def _register(spark, sf: str) -> DataFrame:
    """Documents as entries of a register with keys that are numbers in letters."""
    return table(spark, sf, "documents").select((F.col("doc_id") * 7 + 3).cast("string").alias("entry"), "source")


@query
def register_ranges(spark, sf):
    """Ranges of a register's keys, of at most 300 each."""
    return ranges.key_ranges(_register(spark, sf), "entry", 300)


@query
def register_pages(spark, sf):
    """How many entries each page of each range has."""
    return ranges.pages_of(_register(spark, sf), "entry", 300, 50).groupBy("range_no", "page_no").agg(F.count("*").alias("n"), F.min("entry").alias("first"))


@query
def register_completeness(spark, sf):
    """Whether the entries without those of one source are as many as the register states."""
    rows = _register(spark, sf)
    return ranges.completeness(rows.where("source <> 'src0'"), "entry", rows.agg(F.count("*").alias("total")))
