"""Queries over details, names and reports: each an operator or column expressions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import dose
from evidentia.functions import text as t
from evidentia.operators import changes, details, evidence, listing, resolution, vectors
from evidentia.plans.queries import asked, query
from evidentia.sources import domain, loaders
from evidentia.sources.domain import table

#: Texts that stand for what names, cells and notes look like; a part has one of each by its key.
NAMES = ["ALCOHOL DENAT.", "Aqua / Water", "Rosa Damascena Flower Oil", "Hyaluronic Acid", "Parfum", "Salicylic Acid", "Collagen (soluble/native)", "C12-15 Alkyl Benzoate"]
CN_NAMES = ["变性乙醇", "水", "精油", None, "香精（天然）", "水杨酸", "", "碳 酯"]
CELLS = ["成分\n名称", "Sodium\nHyaluronate", "C12-15 Alkyl-\nBenzoate", "甘油 \n Glycerin", "plain"]
LISTS = ["保湿、美白，抗皱;water", "WATER、BUTYLENE GLYCOL，甘油", "提亮肤色；提亮肤色、使用后皮肤柔软光滑细腻有弹性", "", "a,b"]
PRICES = ["￥1,299.00 起", "89元", "no price", "12,345,678", "3.50"]
NOTES = ["0.5-1.0%", "=A1", "up to 2 %", "none", "PMID: 123456 and [3][1][3]"]
BRANDS = ["理肤泉 La Roche-Posay", "理肤泉", "OLAY 玉兰油", "SK-II", None, " "]


def pick(values: list, key: str = "p_partkey") -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), (F.col(key) % len(values)).cast("int"))


@query
def point_lookup(spark, sf):
    return details.lookup(domain.components(spark, sf).select("ingredient_id", "inci_name", "cn_name"), "ingredient_id", 7)


@query
def item_details(spark, sf):
    # a third of the components have evidence, so that both answers occur
    known = domain.assertions(spark, sf).where(F.col("ingredient_id") % 3 == 0)
    return details.item_details(domain.orders(spark, sf), domain.links(spark, sf, "l_orderkey"), domain.components(spark, sf), known).select("product_id", "ingredient_id", "position", "inci_name", "cn_name", "has_evidence")


@query
def component_details(spark, sf):
    found = details.component_details(domain.components(spark, sf), domain.links(spark, sf, "l_orderkey"), domain.assertions(spark, sf), limit=5, offset=2)
    return found.select("ingredient_id", "inci_name", "legal_cap", "max_leave_on", "max_rinse_off", "total", "assertion_count", "items")


@query
def page_totals(spark, sf):
    listed = listing.list_items(domain.orders(spark, sf), domain.links(spark, sf, "l_orderkey"), domain.snapshots(spark, sf), brand="BUILDING", has_claims="true")
    return details.page_with_total(listed, listing.sort_order("claim_count"), limit=20, offset=10).select("product_id", "claim_count", "ingredient_count", "total")


@query
def text_filters(spark, sf):
    name = F.concat(F.col("p_name"), pick(["", " 5%", "_x", "\\y"]))
    rows = table(spark, sf, "part").select("p_partkey", name.alias("name"), F.col("p_type").alias("kind"), F.lower(F.regexp_extract("p_name", r"^(\S+)", 1)).alias("head"))
    tests = {
        "has_percent": "name like '%5!%%' escape '!'",
        "has_underscore": "name like '%!_%' escape '!'",
        "inner_wildcard": "name like '%e%d%'",
        "same_kind": "kind ilike 'stand%'",
        "has_upper": "name rlike '[A-Z]'",
        "holds_head": "contains(lower(name), head)",
    }
    return rows.select("p_partkey", *[F.expr(x).alias(k) for k, x in tests.items()])


@query
def name_expressions(spark, sf):
    name, cn, brand = pick(NAMES), pick(CN_NAMES), pick(BRANDS)
    rows = table(spark, sf, "part").select("p_partkey", name.alias("name"), cn.alias("cn"), brand.alias("brand"), F.lit("理肤泉").alias("own"))
    name, cn, brand = F.col("name"), F.col("cn"), F.col("brand")
    official = F.when(F.array_contains(t.official_keys(name), "ALCOHOL DENAT"), F.lit("变性 乙醇"))
    return rows.select(
        "p_partkey",
        t.bare_name(name).alias("bare"),
        t.is_alcohol(name, cn).alias("alcohol"),
        t.is_acid(name, cn).alias("acid"),
        t.is_fragrance(name, cn).alias("fragrance"),
        t.component_key(name, cn, official).alias("component_key"),
        t.same_brand(brand, F.col("own")).alias("same_brand"),
        t.brand_group(brand).alias("brand_group"),
        t.brand_head(brand).alias("brand_head"),
        t.has_cjk(cn).alias("has_cjk"),
        t.canonical_water(name).alias("water"),
        t.mixture_part(name).alias("mixture_part"),
        t.mixture_word(name).alias("mixture_word"),
        t.slash_in_parentheses(name).alias("slash_inside"),
        t.stem(name).alias("stem"),
        F.array_join(t.title_tokens(name), " ").alias("tokens"),
        F.array_join(t.name_tokens(name), " ").alias("words"),
        t.collapse(name).alias("collapsed"),
    )


@query
def note_expressions(spark, sf):
    cell, listed, price, note = pick(CELLS), pick(LISTS), pick(PRICES), pick(NOTES)
    rows = table(spark, sf, "part").select("p_partkey", "p_size", cell.alias("cell"), listed.alias("listed"), price.alias("price"), note.alias("note"))
    category = F.when(F.col("p_partkey") % 2 == 0, "美白").otherwise("芳香")
    stated = t.stated_phrases(F.col("listed"), category, "其他")
    return rows.select(
        "p_partkey",
        t.join_wrapped(F.col("cell")).alias("cell"),
        F.array_join(t.latin_parts(F.col("listed")), "|").alias("latin"),
        F.array_join(stated["phrases"], "|").alias("phrases"),
        stated["skipped"].alias("skipped"),
        F.array_join(t.effect_phrases(F.col("listed")), "|").alias("effects"),
        F.array_join(t.list_words(F.col("listed")), "|").alias("words"),
        t.marked_price(F.col("price")).alias("price"),
        t.percent_range(F.col("note"))["low"].alias("low"),
        t.percent_range(F.col("note"))["high"].alias("high"),
        t.paper_id(F.col("note")).alias("paper"),
        F.array_join(t.citations(F.col("note")).cast("array<string>"), ",").alias("cited"),
        t.needs_hedge(F.col("note")).alias("needs_hedge"),
        t.plain_number(F.col("p_size") / F.lit(8.0)).alias("number"),
        t.profile_key(F.col("cell")).alias("key"),
        t.evaluation_tier(pick(["人体功效评价试验", "实验室试验", "其他"])).alias("tier"),
    )


@query
def dose_axis(spark, sf):
    part = domain.components(spark, sf)
    typical = F.when(F.col("ingredient_id") % 7 == 0, F.col("legal_cap") / 2)
    cap = dose.upper_cap(F.col("legal_cap"), F.col("max_leave_on"), F.col("max_rinse_off"), F.lit(None).cast("double"), typical, F.col("ingredient_id") % 2 == 0)
    return part.select("ingredient_id", cap.alias("cap"), F.round(dose.axis_place(F.col("mw") / 7 - 1), 4).alias("place"))


@query
def status_order(spark, sf):
    order = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    place = F.row_number().over(details.Window.partitionBy("o_orderpriority").orderBy(details.in_order_of("o_orderstatus", ["P", "O"]), "o_orderkey"))
    return order.select("o_orderkey", "o_orderstatus", place.cast("long").alias("place"))


@query
def natural_order(spark, sf):
    stem = F.concat(F.lit("file"), F.col("s_suppkey").cast("string"))
    rows = table(spark, sf, "supplier").select((F.col("s_suppkey") % 10).alias("folder"), stem.alias("stem"))
    return rows.select("folder", "stem", F.row_number().over(details.Window.partitionBy("folder").orderBy(*details.natural_order("stem"))).cast("long").alias("place"))


@query
def share_of_greatest(spark, sf):
    counted = domain.links(spark, sf).groupBy("product_id", (F.col("ingredient_id") % 9).alias("family")).agg(F.count("*").alias("n"))
    return details.share_of_greatest(counted, "product_id", "n")


@query
def most_frequent(spark, sf):
    return details.most_frequent(domain.links(spark, sf), "ingredient_id", 20)


@query
def unmapped_by_coverage(spark, sf):
    return details.unmapped_by_coverage(domain.links(spark, sf, "l_orderkey"), domain.components(spark, sf))


@query
def ordered_union(spark, sf):
    part = table(spark, sf, "part")
    first = part.where(F.col("p_size") > 40).select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"))
    second = part.where(F.col("p_retailprice") > 1500).select(F.col("p_partkey").alias("id"), (-F.col("p_partkey")).alias("place"))
    return details.ordered_union([first, second], "id")


@query
def subset_items(spark, sf):
    own = domain.links(spark, sf).groupBy("product_id").agg(F.collect_set(F.col("ingredient_id") % 12).alias("kinds"))
    wanted = F.array(*[F.lit(k).cast("long") for k in (1, 5, 7)])
    return own.select("product_id", (F.size(F.array_except(wanted, "kinds")) == 0).alias("holds_all"), F.size("kinds").alias("n_kinds"))


@query
def typical_doses(spark, sf):
    line = table(spark, sf, "lineitem")
    percent = lambda name: F.round(F.col(name) * 100).cast("int").cast("string")
    pct = F.when(F.col("l_linenumber") == 7, "=B2").otherwise(F.concat(percent("l_discount"), F.lit("-"), percent("l_tax")))
    return details.typical_doses(line.select(F.col("l_partkey").alias("ingredient_id"), F.col("l_suppkey").alias("formulation"), t.percent_range(pct).alias("pct")))


@query
def following_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = details.following_lines(lines, "doc_id", "pos", "line", F.length("line") < 120, F.length("line") > 400)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("distance").cast("long").alias("distance"), F.length("between").cast("long").alias("n_between"))


@query
def contained_names(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("name")).where(F.length("name") >= 2)
    return details.contained_names(names, part.select(F.lower("p_name").alias("other")))


@query
def mutual_brands(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    words = table(spark, sf, "customer").select(F.substring("c_mktsegment", 1, 4).alias("name")).unionByName(nation.select(F.substring("name", 1, 8).alias("name"))).unionByName(nation.select(F.concat("name", F.lit(" Ltd")).alias("name")))
    return details.mutual_names(nation, words)


@query
def repair_from_backup(spark, sf):
    stored = domain.suppliers(spark, sf)
    backup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("product_id"), F.upper("s_name").alias("name"), F.abs("s_acctbal").alias("price")).where(F.col("product_id") % 2 == 1)
    return details.repair(stored.select("product_id", "name", "price"), backup, t.collapse(F.col("name")), t.collapse(F.col("name")), ["price"], [F.col("product_id")])


@query
def unique_hits(spark, sf):
    register = table(spark, sf, "part").select((F.col("p_partkey") % 1500).alias("number"), F.col("p_partkey").alias("found"))
    return details.unique_hits(table(spark, sf, "supplier").select((F.col("s_suppkey") * 37).alias("number")), register, "number", "found")


@query
def override_rows(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("cap"))
    action = F.when(F.col("p_partkey") % 3 == 0, "set").when(F.col("p_partkey") % 3 == 1, "withdraw").otherwise("note")
    review = table(spark, sf, "part").where(F.col("p_partkey") % 5 == 0).select("p_partkey", action.alias("action"), (F.col("p_size") * 2).alias("value"))
    return details.override(rows, review, "p_partkey", "cap")


@query
def rejected_parents(spark, sf):
    verified, _ = changes.split_rows(domain.assertions(spark, sf), (F.col("strength") >= 0.3) & (F.col("level") != "oral"))
    kept, lost = details.parents_with_children(domain.components(spark, sf).select("ingredient_id"), verified, "ingredient_id")
    return kept.withColumn("kept", F.lit(True)).unionByName(lost.withColumn("kept", F.lit(False)))


@query
def backfill_corrected(spark, sf):
    part = table(spark, sf, "part")
    stored = part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("cap"))
    new = part.where(F.col("p_partkey") % 2 == 0).select("p_partkey", F.when(F.col("p_partkey") % 8 != 0, F.col("p_size") + F.col("p_partkey") % 4).cast("int").alias("cap"))
    return changes.backfill(stored, new, ["p_partkey"], "cap", correct=True, clear_none=True)


@query
def formula_tags(spark, sf):
    links = domain.links(spark, sf).select("product_id", "ingredient_id").distinct()
    of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), (F.col("ingredient_id") % len(values)).cast("int"))
    # one component in 64 bears its sample name, so that items differ
    rare = lambda values: F.when(F.col("ingredient_id") % 64 < len(values), of(values))
    flags = {"alcohol": t.is_alcohol(rare(NAMES), rare(CN_NAMES)), "fragrance": t.is_fragrance(rare(NAMES), rare(CN_NAMES))}
    rows = links.groupBy("product_id").agg(*[F.max(x).alias(k) for k, x in flags.items()], F.max(F.col("ingredient_id") % 200 == 0).alias("preservative"))
    tags = F.array_compact(F.array(F.when(~F.col("alcohol"), "无酒精"), F.when(~F.col("fragrance"), "无香精"), F.when(F.col("preservative"), "含防腐剂")))
    return rows.select("product_id", F.array_join(tags, "、").alias("tags"))


@query
def one_hot_topk(spark, sf):
    return vectors.cosine_neighbours(vectors.one_hot(domain.links(spark, sf)), asked(domain.suppliers(spark, sf)), 10)


@query
def hybrid_topk(spark, sf):
    links = domain.links(spark, sf)
    both = vectors.hybrid(vectors.one_hot(links), vectors.rank_decay(links))
    return vectors.cosine_neighbours(both, asked(domain.suppliers(spark, sf)), 10)


@query
def place_correlation(spark, sf):
    links, queries = domain.links(spark, sf), asked(domain.suppliers(spark, sf))
    near = lambda rows: vectors.cosine_neighbours(rows, queries, 30)
    return vectors.place_correlation(near(vectors.one_hot(links)), near(vectors.rank_decay(links)))


SITEMAPS = ["<loc>https://x/dtl/dtl-Ab1.html</loc><loc>https://x/mobile/dtl/dtl-C.html</loc><loc> https://y/dtl/dtl-Ab1.html </loc><loc>https://x/dtl/dtl-Z.html</loc>", "<urlset></urlset>", ""]
EVENTS = ['data: {"part": "a"}\n\ndata: {"part": "b"}\n\ndata: [DONE]\n\n', 'event: x\n\ndata: {broken\n\ndata: {"part": "c"}', ""]
ANSWERS = ['I say: {"winner": "A", "score": 3} so.', "none", '{"winner": null}']
DATES = ["2026-01-31", "2026/3/1", "20260102", "2026-02-30", "soon", None]


@query
def multi_key_match(spark, sf):
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    group = (k % 300).cast("string")
    name = F.concat(F.lit("Skin Líne G"), group, F.when(k % 7 == 0, "（Discontinued）").otherwise(""), F.when(k % 5 == 0, "（G-2）").otherwise(""))
    items = part.select(k.alias("product_id"), name.alias("name"), (F.col("p_size") % 2 == 0).alias("placed"), (F.col("p_size") % 3 == 0).alias("claimed"), (F.col("p_retailprice") > 1400).alias("priced"))
    pages = part.where(k <= 310).select(k.alias("page_id"), F.array(t.name_key(F.concat(F.lit("line-g"), k.cast("string")))).alias("keys"))
    steps = [~F.contains("name", F.lit("Discontinued")), ~F.col("name").rlike(r"（[^）]*-\d+）"), F.col("placed"), F.col("claimed"), F.col("priced")]
    return resolution.match_by_keys(pages, items, steps, "Skin")


@query
def resolve_names(spark, sf):
    part = table(spark, sf, "part")
    first = F.regexp_extract("p_name", r"^(\S+)", 1)
    queries = part.select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, first).otherwise(F.regexp_extract("p_name", r"(\S+)$", 1)).alias("query")).distinct()
    queries = queries.unionByName(spark.createDataFrame([("nothing like it",), ("The Alias",)], "query string"))
    aliases = spark.createDataFrame([("the alias", 5)], "alias string, ingredient_id long")
    return resolution.resolve(queries, part.select(F.col("p_partkey").alias("ingredient_id"), F.col("p_name").alias("name")), aliases)


@query
def verdict_agreement(spark, sf):
    verdicts = evidence.dose_verdicts(domain.links(spark, sf), domain.assertions(spark, sf))
    pairs = domain.suppliers(spark, sf).select(F.col("product_id").alias("a"), (F.col("product_id") + 1).alias("b"))
    return resolution.verdict_agreement(verdicts, pairs)


@query
def targets_in_titles(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return resolution.targets_in_titles(part, F.concat_ws(" ", "p_name", "p_type"), {"ring": ["Ring", "band"], "ed": ["ED"], "economy": ["economy"]}).select("p_partkey", "target")


@query
def page_texts(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", pick(SITEMAPS).alias("sitemap"), pick(EVENTS).alias("events"), pick(ANSWERS).alias("answer"), pick(DATES).alias("day"), "p_size", "p_brand")
    return rows.select(
        "p_partkey",
        F.array_join(t.page_slugs(F.col("sitemap"), r"/dtl/dtl-([A-Za-z0-9]+)\.html", "/mobile/"), ",").alias("slugs"),
        F.array_join(t.stream_parts(F.col("events"), "part"), ",").alias("parts"),
        t.answer_field(F.col("answer"), "winner").alias("winner"),
        t.safe_date(F.col("day")).cast("string").alias("day"),
        F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))).alias("report"),
    )


def _documents(rows, key: str, body: Column):
    return rows.select(F.concat(F.lit("doc-"), F.col(key).cast("string")).alias("path"), F.to_json(body).alias("value"))


@query
def load_market(spark, sf):
    """Every price event as a page of its own document, each document read twice."""
    events = domain.snapshots(spark, sf)
    page = F.struct(
        F.concat(F.lit("u"), F.col("snapshot_id").cast("string")).alias("url"),
        F.col("price"),
        F.col("source").alias("channel"),
        F.col("date").cast("string").alias("date"),
        (F.col("snapshot_id") % 5 == 0).alias("expired"),
        F.when(F.col("snapshot_id") % 3 == 0, "low").otherwise("high").alias("match_confidence"),
    )
    documents = _documents(events, "snapshot_id", F.struct("product_id", F.array(page).alias("pages")))
    none = loaders.rows_of(documents.limit(0), "market").drop("path")
    once = loaders.load(none, documents.unionByName(documents), "market")
    return loaders.latest_prices(loaders.load(once, documents, "market")).withColumn("day", F.col("day").cast("string"))


@query
def load_registry(spark, sf):
    """Every order line as a component of a document of its order's line."""
    line = table(spark, sf, "lineitem")
    component = F.struct(F.concat(F.lit(" c"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_returnflag").alias("safety_risk"), (F.col("l_quantity") > 25).alias("is_active"), F.col("l_linestatus").alias("purpose"))
    body = F.struct(F.concat(F.lit("n"), F.col("l_orderkey").cast("string")).alias("nmpa_id"), F.lit("x").alias("name"), F.array(component).alias("ingredients"))
    documents = _documents(line, "l_linenumber", body).unionByName(spark.createDataFrame([("bad", "{not json"), ("empty", "{}")], "path string, value string"))
    none = loaders.rows_of(documents.limit(0), "registry_components").drop("path")
    loaded = loaders.load(none, documents, "registry_components")
    return loaded.groupBy("nmpa_id").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))
