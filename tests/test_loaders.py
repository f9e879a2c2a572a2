"""Loaders on small documents of each kind."""

import json

import pytest

from evidentia.sources import loaders

DOCUMENTS = {
    "supplier_components": ({"product_name": "P", "producer": "X", "components": ["water ", "甘油", "Glycerin"]}, [("P", "X", "WATER"), ("P", "X", "GLYCERIN")]),
    "formula_doses": ({"formulation": "F", "inci_name": " glycerin", "pct_low": 3.0}, [("GLYCERIN", "F", 3.0, 3.0)]),
    "prices": ({"items": [{"match": "m", "brand": "b", "price": 9.5, "spec": "30ml"}, {"match": "n", "price": 0.0}]}, [("m", "b", 9.5)]),
    "restricted": ({"entries": [{"no": 1, "cn_name": "甲", "inci_name": "a", "scope": "s", "legal_cap": 0.5}]}, [(1, "甲", "A", "s", 0.5)]),
    "effects": ({"categories": [{"code": "01", "name": "美白", "definition": "d"}]}, [("01", "美白", "d")]),
    "market": ({"product_id": 7, "pages": [{"url": "u", "price": 99.0, "date": "2026-07-05", "match_confidence": "high"}, {"url": "v", "match_confidence": "low"}]}, [(7, "2026-07-05", "u", None, 99.0)]),
    "page_components": ({"name": "N", "brand": "B", "ingredients": [{"inci_name": "aqua", "position": 1}]}, [("N", "B", "AQUA", 1)]),
    "registry_components": ({"name": "N", "nmpa_id": "1", "ingredients": [{"name": " x ", "is_active": True}]}, [("1", "N", "x", None, True)]),
    "registry_claims": ({"name": "N", "claims": [{"claim": "保湿", "eval_category": "e"}]}, [(None, "N", "保湿", "e", None)]),
    "seed_products": ({"products": [{"name": "N", "brand": "B", "ingredients": ["a", "b"]}]}, [("N", "B", None, None, None, 2)]),
    "seed_links": ({"name": "N", "brand": "B", "ingredients": ["a", "b"], "trace_ingredients": ["b"], "disclosed": {"a": 2.0}}, [("N", "B", 1, "A", False, 2.0), ("N", "B", 2, "B", True, None)]),
    "compounds": ({"a": {"cid": 5, "mw": "18.0"}, "b": {"cid": 6, "candidates": [6, 7]}}, [("A", 5, None, 18.0)]),
    "aliases": ({"Vit A": "retinol", "none": ""}, [("Vit A", "RETINOL")]),
}


@pytest.mark.parametrize("kind", sorted(loaders.LOADERS))
def test_each_kind_once(spark, kind):
    document, want = DOCUMENTS[kind]
    documents = spark.createDataFrame([("a", json.dumps(document)), ("b", json.dumps(document)), ("c", "{broken"), ("d", None)], "path string, value string")
    none = loaders.rows_of(documents.limit(0), kind).drop("path")
    once = loaders.load(none, documents, kind)
    rows = sorted((tuple(r) for r in once.collect()), key=repr)
    assert [r[: len(w)] for r, w in zip(rows, sorted(want, key=repr))] == sorted(want, key=repr) and len(rows) == len(want)
    stored = spark.createDataFrame(once.collect(), once.schema)
    assert loaders.load(stored, documents, kind).count() == len(want)


def test_latest_prices(spark):
    rows = [(1, "2026-03-01", "a", 109.0, False), (1, "2026-07-05", "b", 99.0, False), (1, "2026-08-01", "c", 50.0, True), (2, "soon", "d", 1.0, False), (3, "2026-01-01", "e", None, False)]
    market = spark.createDataFrame(rows, "product_id long, date string, url string, price double, expired boolean")
    assert [(r.product_id, str(r.day), r.price) for r in loaders.latest_prices(market).collect()] == [(1, "2026-07-05", 99.0)]
