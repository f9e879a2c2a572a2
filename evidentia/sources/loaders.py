"""Loaders as a table: for each kind of documents a schema, the way into its rows, their columns and their natural key.

A loader reads documents (columns path and value, JSON texts) with one plan for all kinds, and adds what a stored table lacks, so
loading the same documents again changes nothing. Documents that aren't JSON of their kind give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as t
from evidentia.operators import changes


@dataclass(frozen=True)
class Loader:
    schema: str
    #: Column expressions over the document `d` and, where there is one, the walked entry `e` (for maps with `key`) and its place `pos`.
    columns: dict[str, str]
    keys: tuple[str, ...]
    #: The array or map whose entries are the rows; empty: a document is one row.
    walk: str = ""
    #: Which rows count.
    only: str = ""


_PRODUCT = "name string, brand string, category string, nmpa_id string, price_current double, ingredients array<string>, trace_ingredients array<string>, disclosed map<string, double>"
_REGISTRY = "name string, nmpa_id string, search_brand string, ingredients array<struct<name string, safety_risk string, is_active boolean, purpose string>>, claims array<struct<claim string, eval_category string, method_name string, institution string>>, registration struct<registrant string, filing_date string>"
_PAGE = "url string, title string, price double, channel string, value_ratio double, date string, year_inferred boolean, expired boolean, comment_count int, match_confidence string"
_ENTRY = "no int, cn_name string, en_name string, inci_name string, scope string, max_conc string, match_inci array<string>, legal_cap double"

#: By the kind of documents.
LOADERS = {
    "supplier_components": Loader(
        "sheet string, product_name string, inci_en string, inci_cn string, function_text string, category string, producer string, dosage string, legal_limit string, components array<string>",
        {"product": "d.product_name", "producer": "d.producer", "component": "upper(trim(e))", "function_text": "d.function_text", "category": "d.category", "dosage": "d.dosage"},
        ("product", "producer", "component"),
        "components",
        "e rlike '[A-Za-z]'",
    ),
    "formula_doses": Loader("formulation string, inci_name string, pct_low double, pct_high double, purpose string", {"inci_name": "upper(trim(d.inci_name))", "formulation": "d.formulation", "low": "d.pct_low", "high": "coalesce(d.pct_high, d.pct_low)"}, ("inci_name", "formulation"), only="d.pct_low is not null"),
    "prices": Loader("items array<struct<match string, brand string, price double, spec string, source_url string, buy_url string, product_id long>>", {"match": "e.match", "brand": "e.brand", "price": "e.price", "spec": "e.spec", "source_url": "e.source_url", "product_id": "e.product_id"}, ("match", "brand"), "items", "e.price > 0"),
    "restricted": Loader(f"entries array<struct<{_ENTRY}>>", {"no": "e.no", "cn_name": "e.cn_name", "inci_name": "upper(trim(e.inci_name))", "scope": "e.scope", "legal_cap": "e.legal_cap"}, ("no",), "entries"),
    "effects": Loader("categories array<struct<code string, name string, definition string, eval_requirement string>>", {"code": "e.code", "name": "e.name", "definition": "e.definition"}, ("code",), "categories"),
    "market": Loader(f"product_id long, query string, pages array<struct<{_PAGE}>>", {"product_id": "d.product_id", "date": "e.date", "url": "e.url", "source": "e.channel", "price": "e.price", "value_ratio": "e.value_ratio", "comment_count": "e.comment_count", "expired": "coalesce(e.expired, false)"}, ("product_id", "date", "url"), "pages", "e.match_confidence = 'high'"),
    "page_components": Loader("name string, brand string, product_slug string, ingredients array<struct<slug string, inci_name string, position int>>", {"product": "d.name", "brand": "d.brand", "inci_name": "upper(trim(e.inci_name))", "position": "e.position"}, ("product", "brand", "position"), "ingredients"),
    "registry_components": Loader(_REGISTRY, {"nmpa_id": "d.nmpa_id", "product": "d.name", "name": "trim(e.name)", "safety_risk": "e.safety_risk", "is_active": "e.is_active", "purpose": "e.purpose"}, ("nmpa_id", "product", "name"), "ingredients"),
    "registry_claims": Loader(_REGISTRY, {"nmpa_id": "d.nmpa_id", "product": "d.name", "claim": "e.claim", "eval_category": "e.eval_category", "method_name": "e.method_name"}, ("nmpa_id", "product", "claim", "eval_category", "method_name"), "claims"),
    "seed_products": Loader(f"products array<struct<{_PRODUCT}>>", {"name": "e.name", "brand": "e.brand", "category": "e.category", "nmpa_id": "e.nmpa_id", "price": "e.price_current", "n_components": "size(e.ingredients)"}, ("name", "brand"), "products"),
    "seed_links": Loader(_PRODUCT, {"product": "d.name", "brand": "d.brand", "position": "pos + 1", "inci_name": "upper(trim(e))", "is_trace": "coalesce(array_contains(d.trace_ingredients, e), false)", "disclosed": "d.disclosed[e]"}, ("product", "brand", "position"), "ingredients"),
    "compounds": Loader("map<string, struct<cid long, matched_by string, status string, mw string, xlogp double, candidates array<long>>>", {"inci_name": "upper(trim(key))", "cid": "e.cid", "status": "e.status", "mw": "try_cast(e.mw AS double)", "xlogp": "e.xlogp"}, ("inci_name",), "map", "coalesce(size(e.candidates), 0) <= 1"),
    "aliases": Loader("map<string, string>", {"alias": "key", "inci_name": "upper(trim(e))"}, ("alias",), "map", "e <> ''"),
}


def rows_of(documents: DataFrame, kind: str) -> DataFrame:
    """The rows of all documents of a kind, with the path of each."""
    loader = LOADERS[kind]
    parsed = documents.select("path", F.from_json("value", loader.schema).alias("d")).where("d is not null")
    if loader.walk == "map":
        parsed = parsed.select("path", F.explode("d").alias("key", "e"))
    elif loader.walk:
        parsed = parsed.select("path", "d", F.posexplode(f"d.{loader.walk}").alias("pos", "e"))
    if loader.only:
        parsed = parsed.where(loader.only)
    return parsed.select("path", *[F.expr(x).alias(name) for name, x in loader.columns.items()])


def load(stored: DataFrame, documents: DataFrame, kind: str) -> DataFrame:
    """`stored` (the columns of the kind) and the rows that it lacks, one of each natural key: that of the first path, then by its columns."""
    loader = LOADERS[kind]
    rows = rows_of(documents, kind)
    order = [F.col("path"), *[F.col(x) for x in loader.columns if x not in loader.keys]]
    return changes.insert_absent(stored, rows, list(loader.keys), order).select(*loader.columns)


def latest_prices(market: DataFrame) -> DataFrame:
    """The price of each item's latest page that has one and hasn't expired."""
    priced = market.where("price is not null and not expired").withColumn("day", t.safe_date(F.col("date")))
    return changes.first_of_each(priced.where("day is not null"), ["product_id"], [F.desc("day"), F.asc("price"), F.asc("url")]).select("product_id", "day", "price")
