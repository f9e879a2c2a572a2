"""Schemas of the stored tables and of the files that are read into them."""

from __future__ import annotations

PRODUCTS = "product_id long, name string, brand string, category string, registry_id string, price double, spec string, source_url string, note string"
COMPONENTS = "ingredient_id long, inci_name string, cn_name string, cas_no string, max_leave_on double, max_rinse_off double, legal_cap double, review_low double, review_high double, typical_low double, typical_high double"
LINKS = "link_id long, product_id long, ingredient_id long, position int, is_trace boolean, disclosed double, conc_low double, conc_high double, confidence double"
EVIDENCE = "evidence_id long, kind string, title string, source string, year int, url string, excerpt string"
ASSERTIONS = "assertion_id long, ingredient_id long, evidence_id long, effect string, family string, effective_low double, effective_high double, level string, strength double, note string"
CLAIMS = "claim_id long, product_id long, claim string, category string, method string, result string, institution string"
PRICES = "product_id long, date date, price double, source string, is_manual boolean"
SNAPSHOTS = "product_id long, date date, source string, price double, value_ratio double, comments int, note string"
MERGES = "kind string, keeper_id long, dup_id long, jaccard double, detail string, created_at timestamp"

#: Files.
EVIDENCE_BATCH = "ingredients array<struct<cn_name string, inci_name string, cas_no string, assertions array<struct<efficacy string, effective_conc_low double, effective_conc_high double, note string, evidence struct<type string, title string, source string, year int, url string, excerpt string>>>>>"
OCR_LINES = "pdf string, page int, text string, width double, height double, lines array<struct<box array<array<double>>, text string, score double>>"
BENCHMARK_CSV = "Label string, Brand string, Name string, Price double, Rank double, Ingredients string, Combination int, Dry int, Normal int, Oily int, Sensitive int"
