"""Every query of the catalogue: an operator applied to the whole of its tables.

Searches ask for each item whose id is divisible by QUERY_STEP, against all items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import rules
from evidentia.functions import text as t
from evidentia.operators import changes, concentration, dedup, evaluation, evidence, listing, matching, pages, similarity, vectors
from evidentia.sources import domain
from evidentia.sources.domain import table

QUERY_STEP = 50
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[plan.__name__] = plan
    return plan


def asked(items: DataFrame, key: str = "product_id") -> DataFrame:
    return items.where(F.col(key) % QUERY_STEP == 0).select(key)


# lists and counts ---------------------------------------------------------------------------------------------------


@query
def stats_overview(spark, sf):
    items, links, assertions = domain.orders(spark, sf), domain.links(spark, sf, "l_orderkey"), domain.assertions(spark, sf)
    counts = [
        ("products", items.agg(F.count("*").alias("n"))),
        ("brands", items.agg(F.count_distinct("brand").alias("n"))),
        ("components", domain.components(spark, sf).agg(F.count("*").alias("n"))),
        ("components_with_evidence", assertions.agg(F.count_distinct("ingredient_id").alias("n"))),
        ("assertions", assertions.agg(F.count("*").alias("n"))),
        ("links", links.agg(F.count("*").alias("n"))),
        ("inferred_products", links.where("conc_low is not null").agg(F.count_distinct("product_id").alias("n"))),
        ("snapshots", domain.snapshots(spark, sf).agg(F.count("*").alias("n"))),
    ]
    found = None
    for name, count in counts:
        row = count.select(F.lit(name).alias("name"), "n")
        found = row if found is None else found.unionByName(row)
    return found


@query
def ingredient_list_counts(spark, sf):
    listed = listing.list_components(domain.components(spark, sf), domain.assertions(spark, sf))
    return listed.select("ingredient_id", "inci_name", "cn_name", "assertion_count")


@query
def ingredient_search_folded(spark, sf):
    return listing.list_components(domain.components(spark, sf), domain.assertions(spark, sf), words="Ed-Ring").select("ingredient_id", "inci_name", "assertion_count")


@query
def product_list_paged(spark, sf):
    items, links = domain.orders(spark, sf), domain.links(spark, sf, "l_orderkey")
    claims = domain.snapshots(spark, sf)
    listed = listing.list_items(items, links, claims)
    page = listing.page(listed, listing.sort_order("ingredient_count"), limit=50, offset=20)
    return page.select("product_id", "name", "brand", "claim_count", "ingredient_count")


@query
def product_filter_semi(spark, sf):
    claims = domain.snapshots(spark, sf).select("product_id", F.col("source").alias("claim"))
    listed = listing.list_items(domain.orders(spark, sf), domain.links(spark, sf, "l_orderkey"), claims, words="urgent", has_claims="true", claim_words=["purch", "sign"])
    return listed.select("product_id", "name", "claim_count", "ingredient_count")


@query
def brands_distinct(spark, sf):
    return listing.brands(domain.orders(spark, sf))


@query
def market_latest_history(spark, sf):
    ranked = listing.latest_and_history(domain.snapshots(spark, sf), "product_id", ["date", "snapshot_id"])
    return ranked.select("product_id", "snapshot_id", "date", "source", "price", "value_ratio", "age_rank", "is_latest")


@query
def penetration(spark, sf):
    return listing.penetration(domain.links(spark, sf, "l_orderkey")).select("ingredient_id", "products", "avg_position", "penetration")


@query
def product_diff(spark, sf):
    items = domain.suppliers(spark, sf).select("product_id")
    following = F.lead("product_id").over(Window.partitionBy((F.col("product_id") / 100).cast("long")).orderBy("product_id"))
    pairs = items.select(F.col("product_id").alias("a"), following.alias("b")).where("b is not null")
    return listing.item_diff(domain.links(spark, sf), "a", "b", pairs)


# evidence -----------------------------------------------------------------------------------------------------------


@query
def ranking_efficacy(spark, sf):
    scored = evidence.efficacy_scores(domain.links(spark, sf), domain.assertions(spark, sf))
    return scored.select("product_id", "family", "ingredient_hits", "human_evidence", "score")


@query
def ranking_efficacy_top(spark, sf):
    top = evidence.efficacy_ranking(domain.links(spark, sf, "l_orderkey"), domain.assertions(spark, sf), "美白", 20)
    return top.select("product_id", "ingredient_hits", "human_evidence", "score")


@query
def evidence_profile(spark, sf):
    return evidence.evidence_profile(domain.links(spark, sf), domain.assertions(spark, sf))


@query
def fingerprint_batch(spark, sf):
    return similarity.fingerprints(domain.links(spark, sf), domain.assertions(spark, sf))


@query
def fingerprint_links(spark, sf):
    links = domain.table(spark, sf, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("link_id"), "*")
    own = links.select(
        "link_id",
        F.col("l_suppkey").alias("product_id"),
        F.col("l_partkey").alias("ingredient_id"),
        (F.col("l_quantity") <= 2).alias("is_trace"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * (1 - F.col("l_discount")) / 10).alias("conc_low"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * (1 + F.col("l_tax")) / 10).alias("conc_high"),
    )
    return similarity.link_fingerprints(own, domain.assertions(spark, sf))


@query
def fingerprint_coverage(spark, sf):
    return similarity.fingerprint_coverage(domain.links(spark, sf), domain.assertions(spark, sf))


@query
def dose_verdicts(spark, sf):
    judged = evidence.dose_verdicts(domain.links(spark, sf), domain.assertions(spark, sf))
    return judged.groupBy("product_id", "verdict").agg(F.count("*").alias("n"))


@query
def effect_rollup(spark, sf):
    judged = evidence.dose_verdicts(domain.links(spark, sf, "l_orderkey"), domain.assertions(spark, sf)).where("verdict is not null")
    return evidence.effect_rollup(judged).select("product_id", "effect", "status", "n")


@query
def verify_board(spark, sf):
    return evidence.verify_board(evidence.dose_verdicts(domain.links(spark, sf), domain.assertions(spark, sf)))


def _priced(spark, sf):
    size = F.when(F.col("product_id") % 11 == 0, "30ml*2").otherwise(F.concat((F.col("product_id") % 90 + 10).cast("string"), F.lit("ml")))
    return domain.suppliers(spark, sf).select("product_id", "price", size.alias("spec"))


@query
def cost_per_dose(spark, sf):
    costed = evidence.costs(_priced(spark, sf), domain.links(spark, sf), domain.assertions(spark, sf)).where("cost is not null")
    return costed.groupBy("product_id", "ingredient_id").agg(F.round(F.min("cost"), 4).alias("min_cost"), F.count("*").alias("n"))


@query
def cost_board(spark, sf):
    return evidence.cost_board(evidence.costs(_priced(spark, sf), domain.links(spark, sf), domain.assertions(spark, sf)))


@query
def match_score(spark, sf):
    items, links, assertions = domain.suppliers(spark, sf), domain.links(spark, sf), domain.assertions(spark, sf)
    kind = F.when(F.col("ingredient_id") % 40 == 0, "alcohol").when(F.col("ingredient_id") % 40 == 1, "fragrance")
    avoided = links.where(F.col("product_id") % 3 == 0).select("product_id", kind.alias("kind")).where("kind is not null")
    claim = F.when(F.col("product_id") % 2 == 0, "保湿（备案）").otherwise("紧致提拉")
    goals = {"美白": ["美白"], "抗老": ["抗皱", "紧致", "抗氧化"], "保湿": ["保湿"], "祛痘": ["控油祛痘"]}
    facts = evidence.match_facts(links, assertions, evidence.dose_verdicts(links, assertions), avoided, items.select("product_id", claim.alias("claim")), goals)
    return evidence.match_score(items, facts)


@query
def transdermal(spark, sf):
    named = domain.components(spark, sf).withColumn("inci_name", F.when(F.col("ingredient_id") % 13 == 0, F.concat(F.lit("Sodium "), "inci_name")).when(F.col("ingredient_id") % 13 == 1, F.concat("inci_name", F.lit("ate"))).otherwise(F.col("inci_name")))
    return evidence.skin_penetration(named)


@query
def canonicalize(spark, sf):
    rows = domain.assertions(spark, sf)
    return rows.select("assertion_id", "effect", rules.canonical_family(F.col("effect")).alias("canonical"), rules.family_or_canonical(F.col("family"), F.col("effect")).alias("used_family"))


#: Notes and excerpts by number, so that every rule is met.
NOTES = ["口服试验", "综述（豚鼠）", "小鼠", "体外试验", "人体外用试验", "消费者测试", "随机双盲", "随机开放标签", "临床观察性", "临床", "", None]
EXCERPTS = ["随机对照", "人体皮肤外植体", "动物", "观察性 随机分组", None]


@query
def evidence_level(spark, sf):
    k = F.col("p_partkey")
    pick = lambda values, index: F.get(F.array(*[F.lit(x) for x in values]), index.cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", pick(NOTES, k % 12).alias("note"), pick(domain.KINDS, k % 7).alias("kind"), pick(EXCERPTS, k % 5).alias("excerpt"))
    level = rules.evidence_level(F.col("note"), F.col("kind"), F.col("excerpt"))
    return rows.select("p_partkey", level.alias("level"), rules.strength_of(level).alias("strength"))


# similarity ---------------------------------------------------------------------------------------------------------


@query
def l1_jaccard(spark, sf):
    return similarity.similar_by_components(domain.links(spark, sf), asked(domain.suppliers(spark, sf)), 10)


@query
def l2_dose(spark, sf):
    return similarity.similar_by_dose(domain.links(spark, sf), asked(domain.suppliers(spark, sf)), 10)


@query
def l3_cosine(spark, sf):
    profiles = similarity.fingerprints(domain.links(spark, sf), domain.assertions(spark, sf))
    return similarity.similar_by_effects(profiles, asked(domain.suppliers(spark, sf)), 10)


@query
def substitutes(spark, sf):
    links, items = domain.links(spark, sf), domain.suppliers(spark, sf)
    found = similarity.substitutes(items, links, similarity.fingerprints(links, domain.assertions(spark, sf)), asked(items), 10)
    return found.drop("shared")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query
def knn_embedding(spark, sf):
    rows = _vectors(spark, sf)
    return vectors.nearest(rows, rows.where(F.col("id") % QUERY_STEP == 0), 10)


@query
def knn_pooled(spark, sf):
    rows = _vectors(spark, sf)
    pool = table(spark, sf, "embeddings").where("label < 5").select(F.col("vec_id").alias("id"))
    return vectors.pooled_nearest(rows, pool, rows.where(F.col("id") % QUERY_STEP == 0), 10)


@query
def knn_label_rate(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return vectors.label_agreement(knn_embedding(spark, sf), labels)


@query
def similarity_percentiles(spark, sf):
    found = vectors.percentiles(knn_embedding(spark, sf), "score", [0.1, 0.5, 0.9])
    rows = knn_embedding(spark, sf).agg(found.alias("p"))
    return rows.select(*[F.round(F.get("p", F.lit(i)), 6).alias(name) for i, name in enumerate(("p10", "p50", "p90"))])


@query
def tfidf_topk(spark, sf):
    links = domain.links(spark, sf)
    return vectors.cosine_neighbours(vectors.tf_idf(links), asked(domain.suppliers(spark, sf)), 10)


@query
def rank_decay_topk(spark, sf):
    return vectors.cosine_neighbours(vectors.rank_decay(domain.links(spark, sf, "l_orderkey")), asked(domain.orders(spark, sf)), 10)


@query
def dupe_analysis(spark, sf):
    links, items = domain.links(spark, sf), domain.suppliers(spark, sf)
    queries = asked(items)
    near = vectors.cosine_neighbours(vectors.tf_idf(links), queries, 10)
    return vectors.cheaper_alternatives(near, similarity.component_overlap(links, queries), items, 0.1)


@query
def topk_agreement(spark, sf):
    links, queries = domain.links(spark, sf), asked(domain.suppliers(spark, sf))
    return vectors.list_agreement(similarity.similar_by_components(links, queries, 10), vectors.cosine_neighbours(vectors.tf_idf(links), queries, 10))


# texts and matching -------------------------------------------------------------------------------------------------


@query
def alias_in_text(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    phrases = table(spark, sf, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    return matching.phrases_in_texts(texts, phrases)


@query
def evidence_pack(spark, sf):
    """Benchmark passages as questions, documents that hold them as entities, their labels as evidence."""
    found = alias_in_text(spark, sf)
    documents = table(spark, sf, "documents")
    hits = found.join(documents.select(F.col("doc_id").alias("text_id"), F.length("text").alias("length"), (F.col("doc_id") % 3 + 1).alias("stage")), "text_id")
    hits = hits.select(F.col("phrase_id").alias("question_id"), F.col("text_id").alias("entity_id"), "stage", "length")
    facts = documents.select(F.col("doc_id").alias("entity_id"), F.posexplode(F.array("lang", "source")).alias("evidence_id", "text"))
    return matching.evidence_pack(hits, facts)


@query
def citations(spark, sf):
    turns = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.concat("text", F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] [1] [07]")).alias("answer"), F.lit(3).alias("n_items"))
    checked = evaluation.cited(turns, "answer", "n_items")
    joined = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ",")
    return checked.select("conv_id", "turn", joined("citations").alias("cited"), joined("invented").alias("invented_citations"))


@query
def claim_split_hedge(spark, sf):
    turns = table(spark, sf, "conversations").where("text is not null")
    answer = F.concat(F.lit("烟酰胺 2% 能美白[1]。过渡句。"), F.replace("text", F.lit("."), F.lit("[2]。")), F.lit("研究中 5%[3]"))
    checked = evaluation.claim_checks(turns.select(F.struct("conv_id", "turn").alias("id"), answer.alias("answer")), "id", "answer")
    return checked.select("id.conv_id", "id.turn", "claim_no", "claim", "needs_hedge")


@query
def eval_scores(spark, sf):
    """Labelled documents as answers: what is wanted and cited, and what lacks support."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    k = F.col("doc_id")
    results = labels.select(
        k.alias("question_id"),
        (k % 5 == 0).alias("refused"),
        F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k, k + 1)).alias("must_cite"),
        F.when(F.col("quality") == 1, F.array(k + 1, k + 2)).otherwise(F.array(k + 3)).alias("cited"),
        F.col("toxic").alias("n_unsupported"),
        (k % 7 == 0).cast("int").alias("n_unhedged"),
    )
    return evaluation.mean_scores(evaluation.answer_scores(results))


@query
def title_gate(spark, sf):
    titles = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("paper_id"), F.col("text").alias("title"))
    changed = F.when(F.col("item_id") % 3 == 0, F.substring("text", 1, 60)).otherwise(F.concat(F.lit("The "), "text"))
    entries = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), (F.col("item_id") + F.when(F.col("item_id") % 10 == 9, 100_000).otherwise(0)).cast("string")).alias("url"), changed.alias("title"))
    return evaluation.title_gate(entries, titles).select("item_id", "similarity", "passes")


@query
def matcher_tiers(spark, sf):
    k = F.col("p_partkey")
    part = table(spark, sf, "part")
    register = part.select(k.alias("value"), F.concat("p_name", F.lit("-"), (k - k % 2).cast("string")).alias("name"))
    written = F.when(k % 3 == 0, F.upper(F.concat("p_name", F.lit("-"), k.cast("string")))).when(k % 3 == 1, F.concat("p_name", F.lit(" "), k.cast("string"))).otherwise(F.concat(F.lit("Alias "), k.cast("string")))
    aliases = part.where(k % 5 != 0).select(F.concat(F.lit("ALIAS "), k.cast("string")).alias("alias"), k.alias("value"))
    names = part.select("p_partkey", written.alias("written"))
    return matching.match_tiers(names, "written", matching.standard_tiers(register, "name", "value", "written", aliases)).select("p_partkey", "matched", "via")


@query
def brand_majority(spark, sf):
    return matching.majority(table(spark, sf, "part"), "p_name", "p_brand")


@query
def name_conflicts(spark, sf):
    return matching.ambiguous(table(spark, sf, "part"), "p_name", "p_type")


@query
def gap_detect(spark, sf):
    return matching.id_gaps(table(spark, sf, "labels").withColumn("fold", F.col("quality")), "fold", "doc_id")


@query
def text_agg(spark, sf):
    links = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    placed = links.select("l_orderkey", "p_name", F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("position"))
    return matching.ordered_text(placed, "l_orderkey", "p_name", "position")


@query
def html_links(spark, sf):
    return pages.links(table(spark, sf, "pages"), "page_id", "html")


@query
def html_items(spark, sf):
    return pages.elements(table(spark, sf, "pages"), "page_id", "html", "li")


@query
def text_entries(spark, sf):
    numbered = pages.lines(table(spark, sf, "documents").where("text is not null"), "doc_id", "text")
    return pages.joined_entries(numbered, "doc_id", F.length("line") > 200)


@query
def normalize_names(spark, sf):
    """Names with noise of every kind put in, and taken out again."""
    k = F.col("p_partkey")
    noise = F.when(k % 6 == 0, F.concat(F.lit("*^ "), "p_name", F.lit("®"))).when(k % 6 == 1, F.concat("p_name", F.lit(" < 0.1%"))).when(k % 6 == 2, F.concat("p_name", F.lit("\\autre nom")))
    noise = noise.when(k % 6 == 3, F.concat("p_name", F.lit(" -> see note"))).when(k % 6 == 4, F.concat(F.lit("é"), "p_name", F.lit(" []"))).otherwise(F.concat("p_name", F.lit("  EXTRAIT DE X")))
    rows = table(spark, sf, "part").select("p_partkey", noise.alias("name"))
    name = t.normalize_name(F.col("name"))
    return rows.select("p_partkey", name.alias("normalized"), t.collapse(name).alias("collapsed"), t.fold(name).alias("folded"))


@query
def decode_lists(spark, sf):
    lists = text_agg(spark, sf).select("l_orderkey", t.list_words(F.concat("text", F.lit("，Unknown thing"))).alias("words"))
    register = table(spark, sf, "part").where("p_name not like 'blue%'")
    return matching.decode(lists, "l_orderkey", "words", register, "p_name", "p_brand").groupBy("l_orderkey").agg(*[F.sum((F.col("status") == x).cast("int")).alias(f"n_{x}") for x in ("hit", "doubt", "miss")])


@query
def global_search(spark, sf):
    return matching.search_all("Ring", 8, product=(domain.orders(spark, sf), "product_id", "name"), component=(domain.components(spark, sf), "ingredient_id", "inci_name"))


@query
def question_items(spark, sf):
    rows = domain.assertions(spark, sf)
    used = rows.withColumn("family", rules.family_or_canonical(F.col("family"), F.col("effect")))
    items = evaluation.question_items(used, rules.HUMAN_LEVELS, 1)
    return items.select("ingredient_id", "family", "kind", F.array_join(F.transform("must_cite", lambda x: x.cast("string")), ",").alias("must_cite"))


@query
def evidence_coverage(spark, sf):
    """Share of each order's links whose component has human evidence."""
    human = domain.assertions(spark, sf).where(F.col("level").isin(rules.HUMAN_LEVELS)).select("ingredient_id").distinct().withColumn("covered", F.lit(1.0))
    joined = domain.links(spark, sf, "l_orderkey").join(human, "ingredient_id", "left")
    return joined.groupBy("product_id").agg(F.round(F.avg(F.coalesce("covered", F.lit(0.0))), 4).alias("coverage"))


@query
def effect_union(spark, sf):
    rows = domain.assertions(spark, sf).groupBy("ingredient_id").agg(F.array_join(F.sort_array(F.collect_set("effect")), "|").alias("effects"))
    return rows


@query
def price_quartiles(spark, sf):
    rows = evaluation.exclusive_quartiles(domain.orders(spark, sf), "brand", "price")
    return rows.select("brand", *[F.round(q, 4).alias(q) for q in ("q1", "q2", "q3")])


@query
def event_windows(spark, sf):
    """The stream's windows over the whole table."""
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"), F.max("value").alias("max_value"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "avg_value", "max_value")


# changes ------------------------------------------------------------------------------------------------------------


def _halves(spark, sf):
    """Snapshots before and from the middle of the month."""
    rows = domain.snapshots(spark, sf).select("product_id", "date", "source", "price", "ts", "snapshot_id")
    return rows.where("date < '2024-01-16'"), rows.where("date >= '2024-01-10'")


@query
def price_upsert(spark, sf):
    old, new = _halves(spark, sf)
    keys, order = ["product_id", "date", "source"], [F.desc("ts"), F.desc("snapshot_id")]
    stored = changes.first_of_each(old, keys, order)
    return changes.upsert(stored, new, keys, order).select(*keys, "price", "snapshot_id")


@query
def insert_if_absent(spark, sf):
    old, new = _halves(spark, sf)
    keys, order = ["product_id", "source"], [F.asc("ts"), F.asc("snapshot_id")]
    return changes.insert_absent(changes.first_of_each(old, keys, order), new, keys, order).select(*keys, "price", "snapshot_id")


def _caps(spark, sf):
    k = F.col("p_partkey")
    stored = table(spark, sf, "part").select("p_partkey", F.when(k % 3 != 0, F.col("p_size")).alias("cap"))
    new = table(spark, sf, "part").where(k % 2 == 0).select("p_partkey", F.when(k % 8 != 0, F.col("p_size") + k % 5).alias("cap"))
    return stored, new


@query
def null_backfill(spark, sf):
    return changes.backfill(*_caps(spark, sf), ["p_partkey"], "cap")


@query
def stale_sync(spark, sf):
    stored, new = _caps(spark, sf)
    return changes.action_counts(changes.sync(stored, new, ["p_partkey"], ["cap"]), "dirty")


@query
def resume_not_done(spark, sf):
    return changes.not_done(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query
def link_orphans(spark, sf):
    """Snapshots of items that no order has, by source."""
    orphans = changes.orphans(domain.snapshots(spark, sf).withColumn("product_id", F.col("product_id") * 997), domain.orders(spark, sf), "product_id")
    return changes.action_counts(orphans, "source")


@query
def recompute_families(spark, sf):
    """Families worked out anew, but for kinds that were set by hand."""
    rows = domain.assertions(spark, sf)
    fixed = F.col("kind").isin("patent", "supplier", "book") & F.col("family").isNotNull()
    return rows.select("assertion_id", F.when(fixed, F.col("family")).otherwise(rules.canonical_family(F.col("effect"))).alias("family"))


@query
def name_cleanup(spark, sf):
    """Links of each order before and after components with one clean name became one."""
    keepers = matching.merged_names(table(spark, sf, "part"), t.collapse(t.normalize_name(F.col("p_name"))), "p_partkey")
    links = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(keepers, F.col("l_partkey") == F.col("p_partkey"))
    return links.groupBy("l_orderkey").agg(F.count("*").alias("n_links"), F.count_distinct("keeper").alias("n_components"))


# duplicates and doses -----------------------------------------------------------------------------------------------


def _document_keys(spark, sf):
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != ""))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("block"), F.explode(words).alias("key"))


@query
def dedup_clusters(spark, sf):
    return dedup.duplicate_clusters(_document_keys(spark, sf))


@query
def dedup_keepers(spark, sf):
    clusters = dedup_clusters(spark, sf)
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    placed = dedup.keepers(clusters.join(documents, "id"), [F.desc("n_chars"), F.asc("source"), F.asc("id")])
    return placed.select("id", "cluster_id", "place")


@query
def dedup_repoint(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic")
    moved = dedup.repoint(labels, dedup_keepers(spark, sf), "id")
    return moved.groupBy("id").agg(F.count("*").alias("n_labels"), F.max("toxic").alias("toxic"))


@query
def concentration_estimates(spark, sf):
    """Dose intervals of all orders that list 2 components or more, the first of which is taken for water."""
    links = domain.links(spark, sf, "l_orderkey")
    once = changes.first_of_each(links, ["product_id", "position"], [F.asc("ingredient_id"), F.asc_nulls_last("conc_low")])
    listed = concentration.listed_components(domain.orders(spark, sf), once, domain.components(spark, sf))
    first = F.min("position").over(Window.partitionBy("product_id"))
    listed = listed.withColumn("water", (F.col("position") == first) & ~F.col("is_trace"))
    return concentration.estimate(listed, **concentration.CALIBRATED)
