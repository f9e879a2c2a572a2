"""DuckDB SQL for the queries over details, names and reports."""

from __future__ import annotations

from evidentia.plans import detail_queries as q
from evidentia.plans.oracles import ASKED_SUPPLIERS, ASSERTIONS, COMPONENTS, JUDGED, ORACLES, ORDERS, SNAPSHOTS, SUPPLIERS, O, S


def _text(value: str | None) -> str:
    if value is None:
        return "NULL"
    parts = value.replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"('{parts}')"


def _pick(values: list, key: str = "p_partkey") -> str:
    return f"[{', '.join(map(_text, values))}][{key} % {len(values)} + 1]"


CAPS = "CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS legal_cap, CASE WHEN p_partkey % 4 <> 0 THEN p_size + 5.0::DOUBLE END AS max_leave_on, CASE WHEN p_partkey % 4 <> 1 THEN p_size + 10.0::DOUBLE END AS max_rinse_off"
ORACLES["point_lookup"] = f"WITH {COMPONENTS} SELECT * FROM components WHERE ingredient_id = 7"
ORACLES["item_details"] = f"""WITH {COMPONENTS}, {ORDERS}, {O} SELECT product_id, l.ingredient_id, position, inci_name, cn_name, CASE WHEN l.ingredient_id IS NOT NULL THEN l.ingredient_id % 3 = 0 END AS has_evidence
FROM items LEFT JOIN links l USING (product_id) LEFT JOIN components c ON c.ingredient_id = l.ingredient_id"""
ORACLES["component_details"] = f"""WITH {O}, own AS (SELECT DISTINCT ingredient_id, product_id FROM links), p AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY product_id) AS rn FROM own),
t AS (SELECT ingredient_id, count(*) AS total, string_agg(product_id::VARCHAR, ',' ORDER BY product_id) FILTER (rn BETWEEN 3 AND 7) AS items FROM p GROUP BY ALL)
SELECT p_partkey AS ingredient_id, p_name AS inci_name, {CAPS}, coalesce(total, 0) AS total, 2::BIGINT AS assertion_count, coalesce(items, '') AS items FROM part LEFT JOIN t ON ingredient_id = p_partkey"""
ORACLES["page_totals"] = f"""WITH {ORDERS}, {O}, {SNAPSHOTS}, c AS (SELECT product_id, count(*) AS claim_count FROM snapshots GROUP BY ALL), i AS (SELECT product_id, count(*) AS ingredient_count FROM links GROUP BY ALL)
SELECT product_id, claim_count, coalesce(ingredient_count, 0) AS ingredient_count, count(*) OVER () AS total FROM items JOIN c USING (product_id) LEFT JOIN i USING (product_id) WHERE brand = 'BUILDING' ORDER BY claim_count DESC, product_id LIMIT 20 OFFSET 10"""
ORACLES["text_filters"] = rf"""WITH r AS (SELECT p_partkey, p_name || ['', ' 5%', '_x', '\y'][p_partkey % 4 + 1] AS name, p_type AS kind, lower(string_split(p_name, ' ')[1]) AS head FROM part)
SELECT p_partkey, contains(name, '5%') AS has_percent, contains(name, '_') AS has_underscore, name LIKE '%e%d%' AS inner_wildcard, kind ILIKE 'stand%' AS same_kind, regexp_matches(name, '[A-Z]') AS has_upper, contains(lower(name), head) AS holds_head FROM r"""
ALCOHOLS, ACIDS = (", ".join(f"'{x}'" for x in names) for names in (q.t.ALCOHOLS, q.t.ACIDS))
ORACLES["name_expressions"] = rf"""WITH r AS (SELECT p_partkey, {_pick(q.NAMES)} AS name, {_pick(q.CN_NAMES)} AS cn, {_pick(q.BRANDS)} AS brand FROM part), b AS (SELECT *, regexp_replace(upper(name), '[.\s]', '', 'g') AS bare, regexp_replace(brand, '[^一-龥]', '', 'g') AS chinese FROM r)
SELECT p_partkey, bare, bare IN ({ALCOHOLS}) OR coalesce(cn IN ({ALCOHOLS}), false) AS alcohol, bare IN ({ACIDS}) OR coalesce(cn IN ({ACIDS}), false) AS acid, regexp_matches(bare, 'FRAGRANCE|PARFUM') OR coalesce(contains(cn, '香精'), false) AS fragrance,
  CASE WHEN name = 'ALCOHOL DENAT.' THEN '变性 乙醇' WHEN regexp_matches(cn, '[一-龥]') THEN trim(regexp_replace(cn, '\s+', ' ', 'g')) ELSE 'INCI:' || upper(name) END AS component_key,
  coalesce(trim(brand) <> '' AND (contains(trim(brand), '理肤泉') OR contains('理肤泉', trim(brand))), false) AS same_brand, coalesce(nullif(chinese, ''), brand, '') AS brand_group, coalesce(nullif(regexp_extract(brand, '[一-龥]+'), ''), trim(brand), '') AS brand_head,
  coalesce(regexp_matches(cn, '[一-龥]'), false) AS has_cjk, CASE WHEN name = 'Aqua / Water' THEN 'WATER' ELSE name END AS water, regexp_matches(upper(name), 'EXTRACT|FERMENT| OIL|BUTTER|WAX|HYDROLYZED|CROSSPOLYMER') OR upper(name) IN ('HYALURONIC ACID', 'COLLAGEN', 'SODIUM HYALURONATE') AS mixture_part,
  list_has_any(string_split(upper(name), ' '), ['EXTRACT', 'OIL', 'BUTTER', 'FERMENT', 'COLLAGEN', 'HYALURONATE', 'HYALURONIC', 'POLYSACCHARIDE', 'PROTEIN']) AS mixture_word, regexp_matches(name, '[(][^)]*/') AS slash_inside, trim(string_split(name, '(')[1]) AS stem,
  array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), ' ') AS tokens, array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), ' ') AS words, regexp_replace(upper(name), '[^A-Z0-9一-鿿]+', '', 'g') AS collapsed FROM b"""
_PARTS = "list_filter(list_transform(regexp_split_to_array(listed, '[、，,；;]'), lambda x: trim(x)), lambda x: x <> '')"
ORACLES["note_expressions"] = rf"""WITH r AS (SELECT p_partkey, p_size, {_pick(q.CELLS)} AS cell, {_pick(q.LISTS)} AS listed, {_pick(q.PRICES)} AS price, {_pick(q.NOTES)} AS note FROM part),
c AS (SELECT *, ['成分名称', 'Sodium Hyaluronate', 'C12-15 Alkyl-Benzoate', '甘油Glycerin', 'plain'][p_partkey % 5 + 1] AS joined, {_PARTS} AS parts, list_transform(regexp_extract_all(note, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS numbers FROM r),
s AS (SELECT *, list_filter(parts, lambda x: regexp_full_match(x, '[一-龥]{{2,8}}')) AS short FROM c),
d AS (SELECT *, list_reduce(list_prepend(5381::BIGINT, list_transform(list_filter(string_split(cell, ''), lambda x: x <> ''), lambda x: ord(x)::BIGINT)), lambda h, x: (h * 33 + x) & 4294967295) AS h FROM s)
SELECT p_partkey, joined AS cell, array_to_string(list_filter(parts, lambda x: regexp_matches(x, '[A-Za-z]')), '|') AS latin,
  array_to_string(CASE WHEN p_partkey % 2 = 0 THEN list_prepend('美白', list_filter(u, lambda x: x <> '美白')) ELSE u END, '|') AS phrases, (len(parts) - len(short))::INT AS skipped, array_to_string(u, '|') AS effects,
  ['保湿|美白|抗皱|water', 'WATER|BUTYLENE GLYCOL|甘油', '提亮肤色|使用后皮肤柔软光滑细腻有弹性', '', 'a|b'][p_partkey % 5 + 1] AS words, [1299.0, 89.0, NULL, 12345678.0, 3.5][p_partkey % 5 + 1]::DOUBLE AS price,
  CASE WHEN NOT contains(note, '=') THEN list_min(numbers[1:2]) END AS low, CASE WHEN NOT contains(note, '=') THEN list_max(numbers[1:2]) END AS high, nullif(regexp_extract(note, 'PMID:\s*(\d+)', 1), '') AS paper,
  CASE WHEN contains(note, '[3]') THEN '1,3' ELSE '' END AS cited, regexp_matches(note, '\d+(?:\.\d+)?\s*%') AND NOT regexp_matches(note, '估计|文献|实验|研究|临床') AS needs_hedge,
  regexp_replace(printf('%.10f', p_size / 8.0::DOUBLE), '\.?0+$', '') AS number, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS key, ['真人实测', '实验室试验', '研究数据'][p_partkey % 3 + 1] AS tier
FROM (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(short, lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS u FROM d)"""
ORACLES["dose_axis"] = f"""WITH c AS (SELECT p_partkey, p_size, {CAPS} FROM part), v AS (SELECT *, least(greatest(p_size * 14.0::DOUBLE / 7 - 1, 0.01::DOUBLE), 100.0::DOUBLE) AS held FROM c)
SELECT p_partkey AS ingredient_id, least(legal_cap, CASE WHEN p_partkey % 2 = 0 THEN max_leave_on ELSE max_rinse_off END, CASE WHEN p_partkey % 7 = 0 THEN legal_cap / 2 END) AS cap, round(100 * (log10(held) + 2) / 4, 4) AS place FROM v"""
ORACLES["status_order"] = "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders"
ORACLES["natural_order"] = "SELECT s_suppkey % 10 AS folder, 'file' || s_suppkey AS stem, row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey) AS place FROM supplier"
ORACLES["share_of_greatest"] = f"WITH {S}, n AS (SELECT product_id, ingredient_id % 9 AS family, count(*) AS n FROM links GROUP BY ALL) SELECT *, round(100.0::DOUBLE * n / max(n) OVER (PARTITION BY product_id), 2) AS share FROM n"
ORACLES["most_frequent"] = f"WITH {S} SELECT ingredient_id, count(*) AS n FROM links GROUP BY ALL ORDER BY n DESC, ingredient_id LIMIT 20"
ORACLES["unmapped_by_coverage"] = f"WITH {COMPONENTS}, {O} SELECT ingredient_id, inci_name, count(DISTINCT product_id) AS items FROM components JOIN links USING (ingredient_id) WHERE cn_name IS NULL GROUP BY ALL ORDER BY items DESC, inci_name DESC LIMIT 30"
ORACLES["ordered_union"] = """SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 0 ELSE 1 END AS list, CASE WHEN p_size > 40 THEN p_partkey ELSE -p_partkey END AS place FROM part WHERE p_size > 40 OR p_retailprice > 1500"""
ORACLES["subset_items"] = f"WITH {S} SELECT product_id, bool_or(ingredient_id % 12 = 1) AND bool_or(ingredient_id % 12 = 5) AND bool_or(ingredient_id % 12 = 7) AS holds_all, count(DISTINCT ingredient_id % 12)::INT AS n_kinds FROM links GROUP BY ALL"
ORACLES["typical_doses"] = """WITH p AS (SELECT l_partkey AS ingredient_id, l_suppkey, round(l_discount * 100) AS a, round(l_tax * 100) AS b FROM lineitem WHERE l_linenumber <> 7)
SELECT ingredient_id, min(least(a, b)) AS typical_low, max(greatest(a, b)) AS typical_high, count(DISTINCT l_suppkey) AS formulations FROM p GROUP BY ALL"""
ORACLES["following_lines"] = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
f AS (SELECT a.doc_id, a.pos, min(b.pos) AS at FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 6 WHERE length(a.line) < 120 AND length(b.line) > 400 GROUP BY ALL),
g AS (SELECT f.doc_id, f.pos, f.at - f.pos AS distance, sum(length(l.line) + 1) AS chars FROM f LEFT JOIN l ON l.doc_id = f.doc_id AND l.pos > f.pos AND l.pos < f.at GROUP BY ALL)
SELECT doc_id, pos::BIGINT AS pos, distance::BIGINT AS distance, greatest(coalesce(chars, 1) - 1, 0)::BIGINT AS n_between FROM g"""
ORACLES["contained_names"] = """WITH n AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_name), '\\s+')) AS name FROM part), o AS (SELECT DISTINCT lower(p_name) AS other FROM part)
SELECT name, other FROM n JOIN o ON contains(other, name) AND name <> other WHERE length(name) >= 2"""
ORACLES["mutual_brands"] = """WITH a AS (SELECT DISTINCT trim(n_name) AS a FROM nation), b AS (SELECT DISTINCT trim(b) AS b FROM (SELECT c_mktsegment[1:4] AS b FROM customer UNION ALL SELECT n_name[1:8] FROM nation UNION ALL SELECT n_name || ' Ltd' FROM nation))
SELECT a AS left, b AS right FROM a JOIN b ON contains(a, b) OR contains(b, a)"""
ORACLES["repair_from_backup"] = f"""WITH {SUPPLIERS} SELECT product_id, name, coalesce(price, CASE WHEN product_id % 2 = 1 THEN abs(s_acctbal) END) AS price, price IS NULL AND product_id % 2 = 1 AS repaired FROM items JOIN supplier ON s_suppkey = product_id"""
ORACLES["unique_hits"] = """WITH r AS (SELECT p_partkey % 1500 AS number, count(*) AS hits, min(p_partkey) AS single FROM part GROUP BY ALL)
SELECT s_suppkey * 37 AS number, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN single END AS found FROM supplier LEFT JOIN r ON number = s_suppkey * 37"""
ORACLES["override_rows"] = """SELECT p_partkey, CASE WHEN p_partkey % 15 = 0 THEN p_size * 2 ELSE p_size END::INT AS cap, CASE WHEN p_partkey % 5 <> 0 THEN 'keep' WHEN p_partkey % 3 = 0 THEN 'set' ELSE 'note' END AS action FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 3 = 1)"""
ORACLES["rejected_parents"] = f"WITH {ASSERTIONS} SELECT p_partkey AS ingredient_id, p_partkey IN (SELECT ingredient_id FROM assertions WHERE strength >= 0.3 AND level <> 'oral') AS kept FROM part"
ORACLES["backfill_corrected"] = """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS old, p_partkey % 2 = 0 AS given, CASE WHEN p_partkey % 8 <> 0 THEN p_size + p_partkey % 4 END::INT AS new FROM part)
SELECT p_partkey, CASE WHEN given AND new IS NULL THEN NULL WHEN given THEN new ELSE old END::INT AS cap, CASE WHEN given AND new IS NULL AND old IS NOT NULL THEN 'cleared' WHEN given AND old IS NULL AND new IS NOT NULL THEN 'set' WHEN given AND old <> new THEN 'corrected' ELSE 'none' END AS action FROM r"""
ORACLES["formula_tags"] = f"""WITH {S} SELECT product_id, concat_ws('、', CASE WHEN NOT bool_or(ingredient_id % 64 IN (0) AND ingredient_id % 64 < 8) THEN '无酒精' END, CASE WHEN NOT bool_or(ingredient_id % 64 = 4) THEN '无香精' END, CASE WHEN bool_or(ingredient_id % 200 = 0) THEN '含防腐剂' END) AS tags FROM links GROUP BY ALL"""

_COSINE = """norms AS (SELECT product_id, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY ALL),
dots AS (SELECT a.product_id AS query_id, b.product_id, sum(a.weight * b.weight) AS dot FROM v a JOIN v b ON a.ingredient_id = b.ingredient_id AND a.product_id <> b.product_id WHERE a.product_id IN (SELECT product_id FROM asked) GROUP BY a.product_id, b.product_id),
scored AS (SELECT query_id, d.product_id, round(dot / (x.norm * y.norm), 4) AS score FROM dots d JOIN norms x ON x.product_id = query_id JOIN norms y ON y.product_id = d.product_id),
ranked AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id)::INT AS rank, score FROM scored WHERE score > 0)"""
_ONE, _DECAY = "SELECT DISTINCT product_id, ingredient_id, 1.0::DOUBLE AS weight FROM links", "SELECT product_id, ingredient_id, 1 / log2(min(position) + 1) AS weight FROM links GROUP BY ALL"
ORACLES["one_hot_topk"] = f"WITH {S}, {ASKED_SUPPLIERS}, v AS ({_ONE}), {_COSINE} SELECT * FROM ranked WHERE rank <= 10"
ORACLES["hybrid_topk"] = f"""WITH {S}, {ASKED_SUPPLIERS}, s AS (SELECT 0 AS side, * FROM ({_ONE}) UNION ALL SELECT 1, * FROM ({_DECAY})),
v AS (SELECT product_id, ingredient_id * 2 + side AS ingredient_id, weight / sqrt(2 * sum(weight * weight) OVER (PARTITION BY side, product_id)) AS weight FROM s), {_COSINE} SELECT * FROM ranked WHERE rank <= 10"""
ORACLES["place_correlation"] = f"""WITH {S}, {ASKED_SUPPLIERS}, a AS (WITH v AS ({_ONE}), {_COSINE} SELECT * FROM ranked WHERE rank <= 30), b AS (WITH v AS ({_DECAY}), {_COSINE} SELECT * FROM ranked WHERE rank <= 30)
SELECT query_id, count(*) AS shared, CASE WHEN count(*) >= 2 AND min(a.rank) < max(a.rank) AND min(b.rank) < max(b.rank) THEN round(corr(a.rank, b.rank), 4) END AS pearson FROM a JOIN b USING (query_id, product_id) GROUP BY query_id"""

_STEPS = ["NOT dropped", "NOT numbered", "placed", "claimed", "priced"]
_NARROWED = ", ".join(f"n{k + 1} AS (SELECT * FROM (SELECT *, bool_or({step}) OVER (PARTITION BY page_id) AS met FROM (SELECT * EXCLUDE met FROM n{k})) WHERE NOT met OR {step})" for k, step in enumerate(_STEPS))
ORACLES["multi_key_match"] = f"""WITH i AS (SELECT p_partkey AS product_id, p_partkey % 300 AS g, p_partkey % 7 = 0 AS dropped, p_partkey % 5 = 0 AS numbered, p_size % 2 = 0 AS placed, p_size % 3 = 0 AS claimed, p_retailprice > 1400 AS priced FROM part),
n0 AS (SELECT p_partkey AS page_id, i.*, true AS met FROM part JOIN i ON g = p_partkey WHERE p_partkey <= 310), {_NARROWED},
c AS (SELECT page_id, count(*) AS candidates FROM n0 GROUP BY ALL), l AS (SELECT page_id, CASE WHEN count(*) = 1 THEN min(product_id) END AS product_id FROM n5 GROUP BY ALL)
SELECT p_partkey AS page_id, coalesce(candidates, 0) AS candidates, product_id FROM part LEFT JOIN c ON c.page_id = p_partkey LEFT JOIN l ON l.page_id = p_partkey WHERE p_partkey <= 310"""
ORACLES["resolve_names"] = r"""WITH q AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN regexp_extract(p_name, '^(\S+)', 1) ELSE regexp_extract(p_name, '(\S+)$', 1) END AS query FROM part UNION ALL VALUES ('nothing like it'), ('The Alias')),
h AS (SELECT query, p_partkey, CASE WHEN upper(query) = upper(p_name) THEN 1 WHEN starts_with(upper(p_name), upper(query)) THEN 2 ELSE 3 END AS tier, length(p_name) AS size FROM (SELECT DISTINCT query FROM q) JOIN part ON contains(upper(p_name), upper(query))),
b AS (SELECT query, first(p_partkey ORDER BY tier, CASE WHEN tier > 1 THEN size END, p_partkey) AS found, min(tier) AS tier FROM h GROUP BY ALL)
SELECT query, CASE WHEN query = 'The Alias' THEN 5 ELSE found END AS ingredient_id, CASE WHEN query = 'The Alias' THEN 'alias' ELSE ['exact', 'prefix', 'part'][tier] END AS via FROM q LEFT JOIN b USING (query)"""
ORACLES["verdict_agreement"] = f"""WITH {ASSERTIONS}, {S}, {JUDGED}, s AS (SELECT product_id, ingredient_id, string_agg(DISTINCT verdict, ',' ORDER BY verdict) AS v FROM judged WHERE verdict IS NOT NULL GROUP BY ALL)
SELECT x.product_id AS a, y.product_id AS b, count(*) AS shared, sum((x.v = y.v)::INT)::BIGINT AS equal FROM s x JOIN s y ON y.product_id = x.product_id + 1 AND y.ingredient_id = x.ingredient_id GROUP BY ALL"""
ORACLES["targets_in_titles"] = """WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS title FROM part)
SELECT p_partkey, 'ring' AS target FROM t WHERE regexp_matches(title, 'ring|band') UNION ALL SELECT p_partkey, 'ed' FROM t WHERE contains(title, 'ed') UNION ALL SELECT p_partkey, 'economy' FROM t WHERE contains(title, 'economy')"""
ORACLES["page_texts"] = """SELECT p_partkey, ['Ab1,Z', '', ''][p_partkey % 3 + 1] AS slugs, ['a,b', 'c', ''][p_partkey % 3 + 1] AS parts, CASE WHEN p_partkey % 3 = 0 THEN 'A' END AS winner,
  ['2026-01-31', '2026-03-01', '2026-01-02', NULL, NULL, NULL][p_partkey % 6 + 1] AS day, '{"size":' || p_size || ',"brand":"' || p_brand || '"}' AS report FROM part"""
ORACLES["load_market"] = f"""WITH {SNAPSHOTS} SELECT product_id, date::VARCHAR AS day, price FROM snapshots WHERE snapshot_id % 3 <> 0 AND snapshot_id % 5 <> 0
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY date DESC, price, 'u' || snapshot_id) = 1"""
ORACLES["load_registry"] = "SELECT 'n' || l_orderkey AS nmpa_id, count(DISTINCT l_partkey) AS n, min('c' || l_partkey) AS first_name FROM lineitem GROUP BY l_orderkey"
