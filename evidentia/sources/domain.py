"""The star schema read as items, components, links and assertions.

An item is an order or a supplier, a component a part, a link a line of an order. The operators take any tables with
these columns; this module is the mapping for the tables at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Effects by the type of a part.
EFFECTS = {"STANDARD": "美白提亮", "ECONOMY": "祛痘（抗菌抗炎）", "MEDIUM": "深层保湿", "PROMO": "防腐", "LARGE": "舒缓抗敏", "SMALL": "芳香"}
LEVELS = ["human_rct", "human_ct", "human_open", "in_vitro", "animal", "oral", "review", "regulation", None]
KINDS = ["paper", "patent", "regulation", "white_paper", "database", "supplier", "book"]
CATEGORIES = {"F": "面霜", "O": "洁面乳", "P": None}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), index.cast("int"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select(
        k.alias("ingredient_id"),
        F.col("p_name").alias("inci_name"),
        F.when(k % 5 != 0, F.concat(F.lit("成分"), k.cast("string"))).alias("cn_name"),
        F.when(k % 3 != 0, F.col("p_size").cast("double")).alias("legal_cap"),
        F.when(k % 4 != 0, (F.col("p_size") + 5).cast("double")).alias("max_leave_on"),
        F.when(k % 4 != 1, (F.col("p_size") + 10).cast("double")).alias("max_rinse_off"),
        (F.col("p_size") * F.lit(14.0)).alias("mw"),
        ((k % 90) / F.lit(10.0) - F.lit(3.0)).alias("xlogp"),
        (k % 17 != 0).alias("has_weight"),
    )


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assertions of each component, by its type and by its size."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    names = F.create_map(*[F.lit(x) for pair in EFFECTS.items() for x in pair])
    effects = F.array(F.element_at(names, F.col("p_type")), _choice(list(EFFECTS.values()), F.col("p_size") % 6))
    rows = part.select("*", F.posexplode(effects).alias("which", "effect"))
    family = F.when(k % 4 == 0, F.lit("保湿")).when(k % 4 == 2, F.lit(""))
    return rows.select(
        (k * 2 + F.col("which")).alias("assertion_id"),
        k.alias("ingredient_id"),
        "effect",
        family.alias("family"),
        F.when(k % 10 != 3, (F.col("p_retailprice") - 900) / 10).alias("effective_low"),
        (F.col("p_size") / F.lit(50.0)).alias("strength"),
        _choice(LEVELS, (F.col("p_size") + F.col("which")) % 9).alias("level"),
        _choice(KINDS, (k + F.col("which")) % 7).alias("kind"),
    )


def links(spark: SparkSession, sf_dir: str, item: str = "l_suppkey") -> DataFrame:
    """Component links of suppliers (l_suppkey) or orders (l_orderkey); lines returned as "N" have no estimate."""
    line = table(spark, sf_dir, "lineitem")
    inferred = F.col("l_returnflag") != "N"
    return line.select(
        F.col(item).alias("product_id"),
        F.col("l_partkey").alias("ingredient_id"),
        F.col("l_linenumber").alias("position"),
        (F.col("l_quantity") <= 2).alias("is_trace"),
        F.when(inferred, F.col("l_quantity") * (1 - F.col("l_discount")) / 10).alias("conc_low"),
        F.when(inferred, F.col("l_quantity") * (1 + F.col("l_tax")) / 10).alias("conc_high"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("brand"))
    supplier = table(spark, sf_dir, "supplier")
    priced = F.when(F.col("s_suppkey") % 7 != 0, F.abs("s_acctbal"))
    joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    return joined.select(F.col("s_suppkey").alias("product_id"), F.col("s_name").alias("name"), "brand", priced.alias("price"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("brand"))
    categories = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    joined = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("product_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("name"),
        "brand",
        F.element_at(categories, F.col("o_orderstatus")).alias("category"),
        F.col("o_totalprice").alias("price"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of items by day and source."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("snapshot_id"),
        F.col("user_id").alias("product_id"),
        F.col("ts"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("source"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("value_ratio"),
    )
