"""DuckDB SQL for the queries of the catalogue, written over the same tables from what each query means."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

RULES = """CASE WHEN regexp_matches({e}, '美白|提亮|淡斑|黄褐斑|黑素|酪氨酸酶') THEN '美白' WHEN regexp_matches({e}, '控油|祛痘|痤疮|粉刺|痘') THEN '控油祛痘'
  WHEN regexp_matches({e}, '抗皱|抗老|细纹|皱纹|胶原|紧致|光老化') THEN '抗皱' WHEN regexp_matches({e}, '抗氧化|光防护|自由基|抗氧') THEN '抗氧化'
  WHEN regexp_matches({e}, '保湿|水合|锁水') THEN '保湿' WHEN regexp_matches({e}, '修护|屏障|修复') THEN '修护'
  WHEN regexp_matches({e}, '舒缓|抗敏|镇静|抗炎|消炎|泛红') THEN '舒缓' WHEN regexp_matches({e}, '焕肤|去角质|剥脱|换肤') THEN '焕肤'
  WHEN contains({e}, '防腐') THEN '防腐' ELSE '其他' END"""

COMPONENTS = """components AS (
  SELECT p_partkey AS ingredient_id, p_name AS inci_name, CASE WHEN p_partkey % 5 <> 0 THEN '成分' || p_partkey END AS cn_name FROM part)"""

ASSERTIONS = f"""effects(n, e) AS (VALUES (0, '美白提亮'), (1, '祛痘（抗菌抗炎）'), (2, '深层保湿'), (3, '防腐'), (4, '舒缓抗敏'), (5, '芳香')),
types(t, n) AS (VALUES ('STANDARD', 0), ('ECONOMY', 1), ('MEDIUM', 2), ('PROMO', 3), ('LARGE', 4), ('SMALL', 5)),
which(which) AS (VALUES (0), (1)),
levels(n, level) AS (VALUES (0, 'human_rct'), (1, 'human_ct'), (2, 'human_open'), (3, 'in_vitro'), (4, 'animal'), (5, 'oral'), (6, 'review'), (7, 'regulation'), (8, NULL)),
kinds(n, kind) AS (VALUES (0, 'paper'), (1, 'patent'), (2, 'regulation'), (3, 'white_paper'), (4, 'database'), (5, 'supplier'), (6, 'book')),
assertions AS (
  SELECT p_partkey * 2 + which AS assertion_id, p_partkey AS ingredient_id, e AS effect,
    coalesce(nullif(CASE WHEN p_partkey % 4 = 0 THEN '保湿' WHEN p_partkey % 4 = 2 THEN '' END, ''), {RULES.format(e='e')}) AS family,
    CASE WHEN p_partkey % 10 <> 3 THEN (p_retailprice - 900) / 10 END AS effective_low, p_size / 50.0::DOUBLE AS strength, level, kind
  FROM part CROSS JOIN which JOIN types ON t = p_type JOIN effects ON effects.n = CASE which WHEN 0 THEN types.n ELSE p_size % 6 END
  JOIN levels ON levels.n = (p_size + which) % 9 JOIN kinds ON kinds.n = (p_partkey + which) % 7)"""


def _links(item: str) -> str:
    return f"""links AS (
  SELECT {item} AS product_id, l_partkey AS ingredient_id, l_linenumber AS position, l_quantity <= 2 AS is_trace,
    CASE WHEN l_returnflag <> 'N' THEN l_quantity * (1 - l_discount) / 10 END AS conc_low, CASE WHEN l_returnflag <> 'N' THEN l_quantity * (1 + l_tax) / 10 END AS conc_high
  FROM lineitem)"""


SUPPLIERS = """items AS (
  SELECT s_suppkey AS product_id, s_name AS name, n_name AS brand, CASE WHEN s_suppkey % 7 <> 0 THEN abs(s_acctbal) END AS price FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
ORDERS = """items AS (
  SELECT o_orderkey AS product_id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS name, c_mktsegment AS brand, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey)"""
SNAPSHOTS = """snapshots AS (
  SELECT event_id AS snapshot_id, user_id AS product_id, ts, ts::DATE AS date, event_type AS source, value AS price, CAST(json_extract(props, '$.k') AS BIGINT) AS value_ratio FROM events)"""
S, O = _links("l_suppkey"), _links("l_orderkey")
ASKED = "asked AS (SELECT product_id FROM items WHERE product_id % 50 = 0)"
ASKED_SUPPLIERS = "asked AS (SELECT s_suppkey AS product_id FROM supplier WHERE s_suppkey % 50 = 0)"
OWN = "own AS (SELECT DISTINCT product_id, ingredient_id FROM links), sizes AS (SELECT product_id, count(*) AS n FROM own GROUP BY ALL)"
OVERLAP = """overlap AS (
  SELECT a.product_id AS query_id, b.product_id, count(*) AS shared, any_value(sa.n) + any_value(sb.n) - count(*) AS union_size
  FROM own a JOIN own b ON a.ingredient_id = b.ingredient_id AND a.product_id <> b.product_id JOIN sizes sa ON sa.product_id = a.product_id JOIN sizes sb ON sb.product_id = b.product_id
  WHERE a.product_id IN (SELECT product_id FROM asked) GROUP BY a.product_id, b.product_id)"""
FACTOR = """CASE WHEN effective_low IS NULL OR effective_low <= 0 THEN 1.0 WHEN is_trace AND effective_low < 0.1 THEN 1.0 WHEN conc_low IS NULL OR conc_high IS NULL THEN 0.5
  ELSE least(greatest((conc_low + conc_high) / 2 / effective_low, 0.0), 1.5) END"""
USABLE = "level IS DISTINCT FROM 'regulation' AND family <> '防腐' AND kind <> 'supplier'"
PROFILES = f"""c AS (SELECT l.product_id, l.ingredient_id, family, floor({FACTOR} * coalesce(strength, 0.0) * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE AS contribution FROM links l JOIN assertions USING (ingredient_id) WHERE {USABLE}),
best AS (SELECT product_id, ingredient_id, family, max(contribution) AS best FROM c WHERE contribution > 0 GROUP BY ALL),
profiles AS (SELECT product_id, family, round(sum(best), 4) AS weight FROM best GROUP BY ALL)"""
VERDICT = """CASE WHEN effective_low IS NULL THEN 'unknown' WHEN is_trace AND effective_low < 0.1 THEN 'trace_level' WHEN conc_high IS NULL THEN NULL
  WHEN conc_low >= effective_low THEN 'effective' WHEN conc_high < effective_low THEN 'insufficient' ELSE 'uncertain' END"""
JUDGED = f"judged AS (SELECT product_id, ingredient_id, effect, CASE WHEN assertion_id IS NOT NULL THEN {VERDICT} END AS verdict FROM links LEFT JOIN assertions USING (ingredient_id) WHERE conc_low IS NOT NULL)"
TFIDF = """n AS (SELECT count(DISTINCT product_id) AS n FROM links), tf AS (SELECT product_id, ingredient_id, count(*) AS times FROM links GROUP BY ALL),
df AS (SELECT ingredient_id, count(*) AS spread FROM tf GROUP BY ALL), v AS (SELECT product_id, ingredient_id, times * ln(n / spread) AS weight FROM tf JOIN df USING (ingredient_id), n WHERE n > spread)"""
COSINE = """norms AS (SELECT product_id, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY ALL),
pairs AS (SELECT a.product_id AS query_id, b.product_id, round(sum(a.weight * b.weight) / (any_value(na.norm) * any_value(nb.norm)), 4) AS score
  FROM v a JOIN v b ON a.ingredient_id = b.ingredient_id AND a.product_id <> b.product_id JOIN norms na ON na.product_id = a.product_id JOIN norms nb ON nb.product_id = b.product_id
  WHERE a.product_id IN (SELECT product_id FROM asked) GROUP BY a.product_id, b.product_id),
near AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id)::INT AS rank, score FROM pairs WHERE score > 0 QUALIFY rank <= 10)"""

ORACLES["stats_overview"] = f"""WITH {ASSERTIONS}, {O}, {ORDERS}
SELECT 'products' AS name, count(*) AS n FROM items UNION ALL SELECT 'brands', count(DISTINCT brand) FROM items UNION ALL SELECT 'components', count(*) FROM part
UNION ALL SELECT 'components_with_evidence', count(DISTINCT ingredient_id) FROM assertions UNION ALL SELECT 'assertions', count(*) FROM assertions UNION ALL SELECT 'links', count(*) FROM links
UNION ALL SELECT 'inferred_products', count(DISTINCT product_id) FROM links WHERE conc_low IS NOT NULL UNION ALL SELECT 'snapshots', count(*) FROM events"""
ORACLES["ingredient_list_counts"] = f"""WITH {COMPONENTS}, {ASSERTIONS}
SELECT ingredient_id, inci_name, cn_name, count(assertion_id) AS assertion_count FROM components LEFT JOIN assertions USING (ingredient_id) GROUP BY ALL"""
ORACLES["ingredient_search_folded"] = f"""WITH {COMPONENTS}, {ASSERTIONS}
SELECT ingredient_id, inci_name, count(assertion_id) AS assertion_count FROM components LEFT JOIN assertions USING (ingredient_id)
WHERE contains(regexp_replace(lower(inci_name), '[\\s-]', '', 'g'), 'edring') GROUP BY ALL"""
ORACLES["product_list_paged"] = f"""WITH {ORDERS}, c AS (SELECT user_id AS product_id, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT l_orderkey AS product_id, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT product_id, name, brand, coalesce(c.n, 0) AS claim_count, coalesce(l.n, 0) AS ingredient_count FROM items LEFT JOIN c USING (product_id) LEFT JOIN l USING (product_id)
ORDER BY ingredient_count DESC, product_id LIMIT 50 OFFSET 20"""
ORACLES["product_filter_semi"] = f"""WITH {ORDERS}, c AS (SELECT user_id AS product_id, count(*) AS n, bool_or(event_type LIKE '%purch%' OR event_type LIKE '%sign%') AS claimed FROM events GROUP BY ALL),
l AS (SELECT l_orderkey AS product_id, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT product_id, name, c.n AS claim_count, coalesce(l.n, 0) AS ingredient_count FROM items JOIN c USING (product_id) LEFT JOIN l USING (product_id) WHERE claimed AND (name ILIKE '%urgent%' OR brand ILIKE '%urgent%')"""
ORACLES["brands_distinct"] = "SELECT DISTINCT c_mktsegment AS brand FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> ''"
ORACLES["market_latest_history"] = f"""WITH {SNAPSHOTS}
SELECT product_id, snapshot_id, date, source, price, value_ratio, row_number() OVER (PARTITION BY product_id ORDER BY date DESC, snapshot_id DESC)::INT AS age_rank, age_rank = 1 AS is_latest FROM snapshots"""
ORACLES["penetration"] = f"""WITH {O}
SELECT ingredient_id, count(DISTINCT product_id) AS products, round(avg(position), 1) AS avg_position, round(count(DISTINCT product_id) / (SELECT count(DISTINCT product_id) FROM links), 4) AS penetration FROM links GROUP BY ALL"""
ORACLES["product_diff"] = f"""WITH {S}, own AS (SELECT DISTINCT product_id, ingredient_id FROM links), p AS (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_suppkey // 100 ORDER BY s_suppkey) AS b FROM supplier QUALIFY b IS NOT NULL),
l AS (SELECT a, b, ingredient_id, true AS in_a FROM p JOIN own ON a = product_id), r AS (SELECT a, b, ingredient_id, true AS in_b FROM p JOIN own ON b = product_id)
SELECT a, b, ingredient_id, CASE WHEN in_a AND in_b THEN 'both' WHEN in_a THEN 'only_a' ELSE 'only_b' END AS side FROM l FULL JOIN r USING (a, b, ingredient_id)"""

RANKED = """ranked AS (
  SELECT product_id, family, count(DISTINCT ingredient_id) AS ingredient_hits, sum((level IN ('human_rct', 'human_ct', 'human_open'))::INT)::BIGINT AS human
  FROM links JOIN assertions USING (ingredient_id) WHERE level IS DISTINCT FROM 'regulation' AND kind <> 'supplier' AND family IN ('美白', '抗皱', '保湿', '舒缓', '控油祛痘', '修护', '抗氧化', '焕肤') GROUP BY ALL),
scored AS (SELECT product_id, family, ingredient_hits, coalesce(human, 0) AS human_evidence, ingredient_hits + 3 * coalesce(human, 0) AS score FROM ranked)"""
ORACLES["ranking_efficacy"] = f"WITH {ASSERTIONS}, {S}, {RANKED} SELECT * FROM scored"
ORACLES["ranking_efficacy_top"] = f"WITH {ASSERTIONS}, {O}, {RANKED} SELECT product_id, ingredient_hits, human_evidence, score FROM scored WHERE family = '美白' ORDER BY score DESC, product_id LIMIT 20"
ORACLES["evidence_profile"] = f"""WITH {ASSERTIONS}, {S}, s(level, strength) AS (VALUES ('human_rct', 1.0::DOUBLE), ('human_ct', 0.8), ('human_open', 0.55), ('in_vitro', 0.5), ('animal', 0.4), ('oral', 0.3), ('review', 0.35), ('regulation', 0.9), ('unknown', 0.2)),
j AS (SELECT product_id, coalesce(level, 'unknown') AS level FROM links JOIN assertions USING (ingredient_id)), t AS (SELECT product_id, count(*) AS total FROM j GROUP BY ALL), c AS (SELECT product_id, level, count(*) AS n FROM j GROUP BY ALL)
SELECT t.product_id, total, s.level, strength::DOUBLE AS strength, coalesce(n, 0) AS count, round(coalesce(n, 0) / total, 4) AS ratio FROM t CROSS JOIN s LEFT JOIN c ON c.product_id = t.product_id AND c.level = s.level"""
ORACLES["fingerprint_batch"] = f"WITH {ASSERTIONS}, {S}, {PROFILES} SELECT * FROM profiles"
ORACLES["fingerprint_links"] = f"""WITH {ASSERTIONS}, links AS (
  SELECT row_number() OVER () AS link_id, l_suppkey AS product_id, l_partkey AS ingredient_id, l_quantity <= 2 AS is_trace, CASE WHEN l_returnflag <> 'N' THEN l_quantity * (1 - l_discount) / 10 END AS conc_low,
    CASE WHEN l_returnflag <> 'N' THEN l_quantity * (1 + l_tax) / 10 END AS conc_high FROM lineitem),
c AS (SELECT link_id, product_id, family, floor({FACTOR} * coalesce(strength, 0.0) * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE AS contribution FROM links JOIN assertions USING (ingredient_id) WHERE {USABLE}),
best AS (SELECT product_id, link_id, family, max(contribution) AS best FROM c WHERE contribution > 0 GROUP BY ALL)
SELECT product_id, family, round(sum(best), 4) AS weight FROM best GROUP BY ALL"""
ORACLES["fingerprint_coverage"] = f"""WITH {ASSERTIONS}, {S}, x AS (SELECT ingredient_id, sum((NOT ({USABLE}))::INT)::BIGINT AS excluded FROM assertions GROUP BY ALL)
SELECT product_id, count(*) AS ingredients_total, count(excluded) AS ingredients_with_assertion, count(conc_low) AS inferred_dose, count(*) - count(conc_low) AS unknown_dose, coalesce(sum(excluded), 0)::BIGINT AS excluded_count
FROM links LEFT JOIN x USING (ingredient_id) GROUP BY ALL"""
ORACLES["dose_verdicts"] = f"WITH {ASSERTIONS}, {S}, {JUDGED} SELECT product_id, verdict, count(*) AS n FROM judged GROUP BY ALL"
ORACLES["effect_rollup"] = f"""WITH {ASSERTIONS}, {O}, {JUDGED}
SELECT product_id, effect, CASE WHEN bool_or(verdict = 'insufficient') THEN 'insufficient' WHEN bool_or(verdict IN ('uncertain', 'trace_level')) THEN 'uncertain' WHEN bool_or(verdict = 'effective') THEN 'effective' ELSE 'unknown' END AS status, count(*) AS n
FROM judged WHERE verdict IS NOT NULL GROUP BY ALL"""
ORACLES["verify_board"] = f"""WITH {ASSERTIONS}, {S}, {JUDGED}
SELECT product_id, sum((coalesce(verdict, 'unknown') <> 'unknown')::INT)::BIGINT AS judged, sum((coalesce(verdict, '') = 'effective')::INT)::BIGINT AS effective, round(sum((coalesce(verdict, '') = 'effective')::INT) / nullif(sum((coalesce(verdict, 'unknown') <> 'unknown')::INT), 0), 4) AS pass_rate FROM judged GROUP BY ALL"""
COSTS = """priced AS (SELECT product_id, price, CASE WHEN product_id % 11 <> 0 THEN (product_id % 90 + 10)::DOUBLE END AS volume FROM items), low AS (SELECT ingredient_id, min(effective_low) AS effective_low FROM assertions GROUP BY ALL),
costs AS (SELECT product_id, ingredient_id, CASE WHEN (conc_low + conc_high) / 2 > 0 THEN price / volume * effective_low / ((conc_low + conc_high) / 2) END AS cost FROM links JOIN priced USING (product_id) LEFT JOIN low USING (ingredient_id) WHERE conc_low IS NOT NULL)"""
ORACLES["cost_per_dose"] = f"WITH {ASSERTIONS}, {S}, {SUPPLIERS}, {COSTS} SELECT product_id, ingredient_id, round(min(cost), 4) AS min_cost, count(*) AS n FROM costs WHERE cost IS NOT NULL GROUP BY ALL"
ORACLES["cost_board"] = f"""WITH {ASSERTIONS}, {S}, {SUPPLIERS}, {COSTS}
SELECT product_id, round(cost, 4) AS min_cost, ingredient_id FROM costs WHERE cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY round(cost, 4), ingredient_id) = 1"""
ORACLES["match_score"] = f"""WITH {ASSERTIONS}, {S}, {SUPPLIERS}, {JUDGED},
aims(family, aim) AS (VALUES ('美白', '美白'), ('抗皱', '抗老'), ('紧致', '抗老'), ('抗氧化', '抗老'), ('保湿', '保湿'), ('控油祛痘', '祛痘')),
own AS (SELECT DISTINCT product_id, family, strength FROM links JOIN assertions USING (ingredient_id) WHERE {USABLE}),
f AS (
  SELECT DISTINCT product_id, 'human' AS rule, aim AS about FROM own JOIN aims USING (family) WHERE strength >= 0.55
  UNION ALL SELECT DISTINCT product_id, 'dose', aim FROM (SELECT product_id, {RULES.format(e='effect')} AS family FROM judged WHERE verdict = 'effective') JOIN aims USING (family)
    WHERE (product_id, aim) IN (SELECT (product_id, aim) FROM own JOIN aims USING (family))
  UNION ALL SELECT DISTINCT product_id, 'avoided', CASE ingredient_id % 40 WHEN 0 THEN 'alcohol' ELSE 'fragrance' END FROM links WHERE product_id % 3 = 0 AND ingredient_id % 40 < 2
  UNION ALL SELECT product_id, 'unsupported', NULL FROM items WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.product_id = items.product_id AND family <> '其他'
    AND CASE WHEN items.product_id % 2 = 0 THEN contains('保湿', family) OR contains(family, '保湿') ELSE contains('紧致提拉', family) OR contains(family, '紧致提拉') END))
SELECT product_id, count(*) FILTER (rule = 'human') AS human, count(*) FILTER (rule = 'dose') AS dose, count(*) FILTER (rule = 'avoided') AS avoided, count(*) FILTER (rule = 'unsupported') AS unsupported,
  least(greatest(20 * human + 10 * dose - 15 * avoided - 10 * unsupported, 0), 100)::INT AS score FROM items LEFT JOIN f USING (product_id) GROUP BY product_id"""
ORACLES["transdermal"] = """WITH n AS (
  SELECT p_partkey AS ingredient_id, upper(CASE p_partkey % 13 WHEN 0 THEN 'Sodium ' || p_name WHEN 1 THEN p_name || 'ate' ELSE p_name END) AS name, CASE WHEN p_partkey % 17 <> 0 THEN p_size * 14.0::DOUBLE END AS mw,
    CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 90) / 10.0::DOUBLE - 3.0::DOUBLE END AS logp FROM part),
i AS (SELECT *, CASE WHEN list_contains(string_split(name, ' '), 'PCA') THEN 'pca' WHEN list_has_any(string_split(name, ' '), ['POTASSIUM', 'DIPOTASSIUM']) THEN 'potassium' WHEN string_split(name, ' ')[1] IN ('SODIUM', 'DISODIUM') THEN 'sodium'
  WHEN name LIKE '%ATE' THEN 'ate' END AS ionic_rule FROM n)
SELECT ingredient_id, ionic_rule, CASE WHEN ionic_rule IS NOT NULL OR mw IS NULL OR mw > 600 THEN 'not_applicable' WHEN mw > 500 THEN 'hard' WHEN logp BETWEEN 1 AND 3 THEN 'easy' WHEN logp BETWEEN 0 AND 4 THEN 'medium' ELSE 'hard' END AS verdict,
  CASE WHEN ionic_rule IS NULL AND mw <= 600 THEN round(-2.7::DOUBLE + 0.71::DOUBLE * logp - 0.0061::DOUBLE * mw, 6) END AS log_kp FROM i"""
ORACLES["canonicalize"] = f"WITH {ASSERTIONS} SELECT assertion_id, effect, {RULES.format(e='effect')} AS canonical, family AS used_family FROM assertions"
ORACLES["evidence_level"] = """WITH r AS (
  SELECT p_partkey, ['口服试验', '综述（豚鼠）', '小鼠', '体外试验', '人体外用试验', '消费者测试', '随机双盲', '随机开放标签', '临床观察性', '临床', '', NULL][p_partkey % 12 + 1] AS note,
    ['paper', 'patent', 'regulation', 'white_paper', 'database', 'supplier', 'book'][p_partkey % 7 + 1] AS kind, ['随机对照', '人体皮肤外植体', '动物', '观察性 随机分组', NULL][p_partkey % 5 + 1] AS excerpt FROM part),
w AS (SELECT p_partkey, CASE
  WHEN contains(note, '口服') THEN 'oral' WHEN contains(note, '综述') THEN 'review' WHEN regexp_matches(note, '动物|豚鼠|小鼠|大鼠') THEN 'animal' WHEN contains(replace(note, '人体外', ''), '体外') THEN 'in_vitro'
  WHEN kind = 'regulation' THEN 'regulation'
  WHEN NOT contains(note, '观察性') AND contains(note, '消费者') THEN 'human_ct'
  WHEN NOT contains(note, '观察性') AND regexp_matches(note, '双盲|RCT|随机') AND NOT regexp_matches(note, '开放|无对照|病例系列') THEN 'human_rct'
  WHEN NOT contains(note, '观察性') AND regexp_matches(note, '双盲|RCT|随机|人体|临床') THEN 'human_open'
  WHEN kind = 'paper' AND contains(excerpt, '动物') THEN 'animal'
  WHEN kind = 'paper' AND NOT contains(excerpt, '观察性') AND regexp_matches(excerpt, '双盲|RCT|随机对照|随机分组') THEN 'human_rct'
  ELSE 'unknown' END AS level FROM r)
SELECT p_partkey, level, CASE level WHEN 'human_rct' THEN 1.0 WHEN 'human_ct' THEN 0.8 WHEN 'human_open' THEN 0.55 WHEN 'in_vitro' THEN 0.5 WHEN 'animal' THEN 0.4 WHEN 'oral' THEN 0.3 WHEN 'review' THEN 0.35 WHEN 'regulation' THEN 0.9 ELSE 0.2 END::DOUBLE AS strength FROM w"""

TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id)::INT AS rank"
ORACLES["l1_jaccard"] = f"""WITH {S}, {ASKED_SUPPLIERS}, {OWN}, {OVERLAP}
SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY shared / union_size DESC, product_id)::INT AS rank, round(shared / union_size, 4) AS score, shared FROM overlap QUALIFY rank <= 10"""
ORACLES["l2_dose"] = f"""WITH {S}, {ASKED_SUPPLIERS}, v AS (SELECT product_id, ingredient_id, max((conc_low + conc_high) / 2) AS weight FROM links WHERE conc_low IS NOT NULL AND conc_high IS NOT NULL GROUP BY ALL),
norms AS (SELECT product_id, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY ALL),
pairs AS (SELECT a.product_id AS query_id, b.product_id, sum(least(a.weight, b.weight) * least(a.weight, b.weight)) AS shared, any_value(na.norm) * any_value(nb.norm) AS norms
  FROM v a JOIN v b ON a.ingredient_id = b.ingredient_id AND a.product_id <> b.product_id JOIN norms na ON na.product_id = a.product_id JOIN norms nb ON nb.product_id = b.product_id WHERE a.product_id IN (SELECT product_id FROM asked) GROUP BY ALL)
SELECT query_id, product_id, round(shared / norms, 4) AS score, {TOP} FROM pairs WHERE shared > 0 QUALIFY rank <= 10"""
EFFECT_PAIRS = """v AS (SELECT * FROM profiles WHERE family <> '其他'), norms AS (SELECT product_id, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY ALL),
effect_pairs AS (SELECT a.product_id AS query_id, b.product_id, sum(a.weight * b.weight) / (any_value(na.norm) * any_value(nb.norm)) AS cosine, count(*) AS dimensions,
    array_to_string(list(a.family ORDER BY least(a.weight, b.weight) DESC, encode(a.family))[1:3], ',') AS top_families
  FROM v a JOIN v b ON a.family = b.family AND a.product_id <> b.product_id JOIN norms na ON na.product_id = a.product_id JOIN norms nb ON nb.product_id = b.product_id WHERE a.product_id IN (SELECT product_id FROM asked) GROUP BY a.product_id, b.product_id)"""
ORACLES["l3_cosine"] = f"WITH {ASSERTIONS}, {S}, {ASKED_SUPPLIERS}, {PROFILES}, {EFFECT_PAIRS} SELECT query_id, product_id, round(cosine, 4) AS score, {TOP}, dimensions, top_families FROM effect_pairs QUALIFY rank <= 10"
ORACLES["substitutes"] = f"""WITH {ASSERTIONS}, {S}, {SUPPLIERS}, {ASKED}, {OWN}, {OVERLAP}, {PROFILES}, {EFFECT_PAIRS}, named AS (SELECT DISTINCT product_id FROM v),
parts AS (SELECT o.query_id, o.product_id, shared / union_size AS i, CASE WHEN o.query_id IN (FROM named) AND o.product_id IN (FROM named) THEN coalesce(cosine, 0.0) END AS e,
    CASE WHEN q.price IS NOT NULL AND p.price IS NOT NULL AND greatest(q.price, p.price) > 0 THEN least(q.price, p.price) / greatest(q.price, p.price) END AS m
  FROM overlap o LEFT JOIN effect_pairs USING (query_id, product_id) JOIN items q ON q.product_id = o.query_id JOIN items p ON p.product_id = o.product_id),
w AS (SELECT *, 0.5::DOUBLE + CASE WHEN e IS NULL THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END AS total FROM parts)
SELECT query_id, product_id, round((i * 0.5::DOUBLE + coalesce(e * 0.3::DOUBLE, 0.0) + coalesce(m * 0.2::DOUBLE, 0.0)) / total, 4) AS score, round(i, 4) AS ingredient_score, round(e, 4) AS efficacy_score, round(m, 4) AS price_score,
  round(0.5::DOUBLE / total, 4) AS ingredient_weight, round(CASE WHEN e IS NULL THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END / total, 4) AS efficacy_weight, round(CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END / total, 4) AS price_weight, {TOP}
FROM w QUALIFY rank <= 10"""


def _knn(pool: str = "") -> str:
    return f"""knn AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, r.vec_id)::INT AS rank
  FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id {pool} QUALIFY rank <= 10)"""


ORACLES["knn_embedding"] = f"WITH {_knn()} SELECT query_id, id, rank, score FROM knn"
ORACLES["knn_pooled"] = f"WITH {_knn('AND r.label < 5')} SELECT query_id, id, rank, score FROM knn"
ORACLES["knn_label_rate"] = f"WITH {_knn()} SELECT query_id, count(*) AS n, round(avg((r.label = q.label)::INT::DOUBLE), 4) AS label_rate FROM knn JOIN embeddings q ON q.vec_id = query_id JOIN embeddings r ON r.vec_id = id GROUP BY ALL"
ORACLES["similarity_percentiles"] = f"WITH {_knn()} SELECT round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90 FROM knn"
ORACLES["tfidf_topk"] = f"WITH {S}, {ASKED_SUPPLIERS}, {TFIDF}, {COSINE} SELECT * FROM near"
ORACLES["rank_decay_topk"] = f"""WITH {O}, asked AS (SELECT o_orderkey AS product_id FROM orders WHERE o_orderkey % 50 = 0), v AS (SELECT product_id, ingredient_id, max(1 / log2(position + 1)) AS weight FROM links WHERE position IS NOT NULL GROUP BY ALL), {COSINE} SELECT * FROM near"""
ORACLES["dupe_analysis"] = f"""WITH {S}, {SUPPLIERS}, {ASKED}, {TFIDF}, {COSINE}, {OWN}, {OVERLAP}, m AS (SELECT quantile_cont(price, 0.5) AS median FROM items),
premium AS (SELECT product_id AS query_id, brand AS query_brand, price AS query_price FROM items, m WHERE price >= median AND product_id IN (SELECT query_id FROM near)),
found AS (SELECT query_id, product_id, shared / union_size AS j, (query_price - price) / query_price AS s, brand <> query_brand AS cross_brand FROM near JOIN overlap USING (query_id, product_id) JOIN items USING (product_id) JOIN premium USING (query_id)
  WHERE price < query_price AND shared / union_size >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY j DESC, product_id) = 1)
SELECT query_id, product_id, round(j, 4) AS jaccard, round(s, 4) AS saving, cross_brand FROM premium LEFT JOIN found USING (query_id)"""
ORACLES["topk_agreement"] = f"""WITH {S}, {ASKED_SUPPLIERS}, {OWN}, {OVERLAP}, {TFIDF}, {COSINE},
l1 AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY shared / union_size DESC, product_id) AS rank FROM overlap QUALIFY rank <= 10),
shared AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY l1.rank)::DOUBLE AS pa, row_number() OVER (PARTITION BY query_id ORDER BY near.rank)::DOUBLE AS pb FROM l1 JOIN near USING (query_id, product_id)),
every AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, product_id FROM l1 UNION SELECT query_id, product_id FROM near) GROUP BY ALL)
SELECT e.query_id, round(count(pa) / any_value(n), 4) AS jaccard, count(pa) AS shared, CASE WHEN count(pa) >= 2 THEN round(corr(pa, pb), 4) END AS spearman FROM every e LEFT JOIN shared USING (query_id) GROUP BY e.query_id"""

HELD = "held AS (SELECT doc_id AS text_id, item_id AS phrase_id FROM documents JOIN benchmark b ON contains(documents.text, b.text))"
ORACLES["alias_in_text"] = f"WITH {HELD} SELECT * FROM held"
ORACLES["evidence_pack"] = f"""WITH {HELD}, hits AS (SELECT phrase_id AS question_id, text_id AS entity_id, text_id % 3 + 1 AS stage, length(text) AS length, max((text_id % 3 + 1 <= 2)::INT) OVER (PARTITION BY phrase_id) AS early FROM held JOIN documents ON doc_id = text_id),
chosen AS (SELECT question_id, entity_id, row_number() OVER (PARTITION BY question_id ORDER BY stage, length DESC, entity_id) AS entity_rank FROM hits WHERE stage <= 2 OR early = 0 QUALIFY entity_rank <= 3),
facts AS (SELECT doc_id AS entity_id, 0 AS evidence_id, lang AS text FROM documents UNION ALL SELECT doc_id, 1, source FROM documents)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY entity_rank, evidence_id)::INT AS item, entity_id, evidence_id, text FROM chosen JOIN facts USING (entity_id) QUALIFY item <= 8"""
ORACLES["citations"] = r"""WITH c AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text || ' [' || (turn + 1) || '] [1] [07]', '\[(\d{1,3})\]', 1), lambda x: x::INT))) AS c FROM conversations)
SELECT conv_id, turn, array_to_string(c, ',') AS cited, array_to_string(list_filter(c, lambda x: x < 1 OR x > 3), ',') AS invented_citations FROM c"""
ORACLES["claim_split_hedge"] = r"""WITH a AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array('烟酰胺 2% 能美白[1]。过渡句。' || replace(text, '.', '[2]。') || '研究中 5%[3]', '[。；;！？!?\n]+'), lambda x: trim(x)), lambda x: regexp_matches(x, '\[\d{1,3}\]')) AS s FROM conversations),
u AS (SELECT conv_id, turn, unnest(s) AS claim, generate_subscripts(s, 1) - 1 AS claim_no FROM a)
SELECT conv_id, turn, claim_no::INT AS claim_no, claim, regexp_matches(claim, '\d+(\.\d+)?\s*%') AND NOT regexp_matches(claim, '估计|文献|实验|研究|临床') AS needs_hedge FROM u"""
ORACLES["eval_scores"] = """WITH r AS (SELECT CASE WHEN doc_id % 4 = 0 THEN (doc_id % 5 = 0)::INT ELSE (quality = 1)::INT END AS e, (toxic = 0)::INT AS v, (doc_id % 7 <> 0)::INT AS d FROM labels)
SELECT count(*) AS n, round(avg(e), 4) AS e, round(avg(v), 4) AS v, round(avg(d), 4) AS d, round(avg(e * v * d), 4) AS score FROM r"""
ORACLES["title_gate"] = """WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(CASE WHEN item_id % 3 = 0 THEN substring(text, 1, 60) ELSE 'The ' || text END), '[a-z0-9]+')) AS a, CASE WHEN item_id % 10 <> 9 THEN list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) END AS b FROM benchmark),
s AS (SELECT item_id, CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) END AS similarity FROM t) SELECT item_id, similarity, similarity >= 0.7 AS passes FROM s"""
ORACLES["matcher_tiers"] = """WITH r AS (SELECT p_partkey AS value, p_name || '-' || (p_partkey - p_partkey % 2) AS name FROM part),
w AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name || '-' || p_partkey) WHEN 1 THEN p_name || ' ' || p_partkey ELSE 'Alias ' || p_partkey END AS written FROM part),
x AS (SELECT upper(name) AS key, min(value) AS value FROM r GROUP BY ALL HAVING count(DISTINCT value) = 1), c AS (SELECT regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS key, min(value) AS value FROM r GROUP BY ALL HAVING count(DISTINCT value) = 1),
a AS (SELECT 'ALIAS ' || p_partkey AS key, p_partkey AS value FROM part WHERE p_partkey % 5 <> 0)
SELECT p_partkey, coalesce(x.value, c.value, a.value) AS matched, CASE WHEN x.value IS NOT NULL THEN 'exact' WHEN c.value IS NOT NULL THEN 'collapsed' WHEN a.value IS NOT NULL THEN 'alias' END AS via
FROM w LEFT JOIN x ON x.key = upper(written) LEFT JOIN c ON c.key = regexp_replace(upper(written), '[^A-Z0-9]', '', 'g') LEFT JOIN a ON a.key = upper(written)"""
ORACLES["brand_majority"] = """WITH c AS (SELECT p_name, p_brand, count(*) AS votes, rank() OVER (PARTITION BY p_name ORDER BY count(*) DESC) AS place FROM part GROUP BY p_name, p_brand)
SELECT p_name, min(p_brand) AS p_brand, max(votes) AS votes FROM c WHERE place = 1 GROUP BY p_name HAVING count(*) = 1"""
ORACLES["name_conflicts"] = "SELECT p_name, count(DISTINCT p_type) AS n_values FROM part GROUP BY p_name HAVING n_values > 1"
ORACLES["gap_detect"] = """SELECT quality AS fold, doc_id + 1 AS first_missing, following - 1 AS last_missing, following - doc_id - 1 AS n_missing
FROM (SELECT quality, doc_id, lead(doc_id) OVER (PARTITION BY quality ORDER BY doc_id) AS following FROM labels) WHERE following - doc_id > 1"""
ORACLES["text_agg"] = """WITH p AS (SELECT l_orderkey, p_name, min(CASE WHEN l_linenumber < 6 THEN l_linenumber ELSE 2147483647 END) AS place FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_orderkey, string_agg(p_name, '、' ORDER BY place, p_name) AS text FROM p GROUP BY ALL"""
PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""
ORACLES["html_links"] = rf"""WITH t AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>') AS tags FROM pages), u AS (SELECT page_id, generate_subscripts(tags, 1) - 1 AS place, unnest(tags) AS tag FROM t)
SELECT page_id, place::INT AS place, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, {PLAIN.format(x="tag")} AS text FROM u"""
ORACLES["html_items"] = rf"""WITH t AS (SELECT page_id, regexp_extract_all(html, '(?s)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS tags FROM pages), u AS (SELECT page_id, generate_subscripts(tags, 1) - 1 AS place, unnest(tags) AS tag FROM t)
SELECT page_id, place::INT AS place, {PLAIN.format(x="tag")} AS text FROM u"""
ORACLES["text_entries"] = r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), u AS (SELECT doc_id, generate_subscripts(lines, 1) AS line_no, unnest(lines) AS line FROM t),
e AS (SELECT *, sum((length(line) > 200)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS entry_no FROM u)
SELECT doc_id, entry_no, count(*) AS n_lines, string_agg(line, ' ' ORDER BY line_no) AS text FROM e GROUP BY ALL"""
ORACLES["normalize_names"] = r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN 'e' || p_name ELSE p_name END AS normalized FROM part)
SELECT p_partkey, normalized, regexp_replace(upper(normalized), '[^A-Z0-9]', '', 'g') AS collapsed, regexp_replace(lower(normalized), '[\s-]', '', 'g') AS folded FROM n"""
HALVES = "olds AS (SELECT * FROM snapshots WHERE date < '2024-01-16'), news AS (SELECT * FROM snapshots WHERE date >= '2024-01-10')"
ORACLES["price_upsert"] = f"""WITH {SNAPSHOTS}, {HALVES}, o AS (SELECT * FROM olds QUALIFY row_number() OVER (PARTITION BY product_id, date, source ORDER BY ts DESC, snapshot_id DESC) = 1),
n AS (SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY product_id, date, source ORDER BY ts DESC, snapshot_id DESC) = 1)
SELECT product_id, date, source, price, snapshot_id FROM n UNION ALL SELECT product_id, date, source, price, snapshot_id FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.product_id = o.product_id AND n.date = o.date AND n.source = o.source)"""
ORACLES["insert_if_absent"] = f"""WITH {SNAPSHOTS}, {HALVES}, o AS (SELECT * FROM olds QUALIFY row_number() OVER (PARTITION BY product_id, source ORDER BY ts, snapshot_id) = 1),
n AS (SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY product_id, source ORDER BY ts, snapshot_id) = 1)
SELECT product_id, source, price, snapshot_id FROM o UNION ALL SELECT product_id, source, price, snapshot_id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.product_id = o.product_id AND n.source = o.source)"""
CAPS = "c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS old, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 8 <> 0 THEN p_size + p_partkey % 5 END AS new FROM part)"
ORACLES["null_backfill"] = f"WITH {CAPS} SELECT p_partkey, coalesce(old, new)::BIGINT AS cap, CASE WHEN old IS NULL AND new IS NOT NULL THEN 'set' WHEN old <> new THEN 'conflict' ELSE 'none' END AS action FROM c"
ORACLES["stale_sync"] = f"WITH {CAPS} SELECT p_partkey % 2 = 0 AND old IS DISTINCT FROM new AS dirty, count(*) AS n FROM c GROUP BY ALL"
ORACLES["resume_not_done"] = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

CLUSTERS = r"""k AS (SELECT doc_id AS id, lang AS block, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> ''))) AS keys FROM documents),
c AS (SELECT id, block, keys, len(keys) AS size, min(id) OVER (PARTITION BY block, keys) AS class_id FROM k WHERE len(keys) > 0), f AS (SELECT * FROM c WHERE id = class_id AND size >= 11),
p AS (SELECT u.id AS u, v.id AS v, u.size AS su, v.size AS sv, len(list_intersect(u.keys, v.keys)) AS shared FROM f u JOIN f v ON u.block = v.block AND u.id > v.id AND abs(u.size - v.size) <= 2),
e AS (SELECT u, v FROM p WHERE shared / least(su, sv) >= 0.93 AND (shared / (su + sv - shared) >= 0.9 OR (shared / (su + sv - shared) >= 0.85 AND shared / least(su, sv) >= 0.96))),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), reach(node, root) AS (SELECT id, id FROM f UNION SELECT b.v, root FROM reach JOIN b ON node = b.u), roots AS (SELECT node, min(root) AS root FROM reach GROUP BY ALL),
degrees AS (SELECT u AS node, count(*) AS n FROM b GROUP BY ALL), clusters AS (SELECT id, class_id, coalesce(root, class_id) AS cluster_id, coalesce(n, 0) AS n_links FROM c LEFT JOIN roots ON roots.node = class_id LEFT JOIN degrees ON degrees.node = class_id)"""
ORACLES["dedup_clusters"] = f"WITH RECURSIVE {CLUSTERS} SELECT * FROM clusters"
KEEPERS = "placed AS (SELECT id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY n_chars DESC, source, id)::INT AS place FROM clusters JOIN documents ON doc_id = id)"
ORACLES["dedup_keepers"] = f"WITH RECURSIVE {CLUSTERS}, {KEEPERS} SELECT * FROM placed"
ORACLES["dedup_repoint"] = f"""WITH RECURSIVE {CLUSTERS}, {KEEPERS}, m AS (SELECT a.id, b.id AS keeper FROM placed a JOIN placed b ON a.cluster_id = b.cluster_id AND b.place = 1)
SELECT coalesce(keeper, doc_id) AS id, count(*) AS n_labels, max(toxic) AS toxic FROM labels LEFT JOIN m ON m.id = doc_id GROUP BY ALL"""

ORACLES["link_orphans"] = f"WITH {SNAPSHOTS} SELECT source, count(*) AS n FROM snapshots WHERE product_id * 997 NOT IN (SELECT o_orderkey FROM orders) GROUP BY ALL"
ORACLES["recompute_families"] = f"""WITH {ASSERTIONS} SELECT assertion_id, CASE WHEN kind IN ('patent', 'supplier', 'book') AND ingredient_id % 4 = 0 THEN '保湿' WHEN kind IN ('patent', 'supplier', 'book') AND ingredient_id % 4 = 2 THEN '' ELSE {RULES.format(e="effect")} END AS family FROM assertions"""
ORACLES["name_cleanup"] = "SELECT l_orderkey, count(*) AS n_links, count(DISTINCT upper(p_name)) AS n_components FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"
ORACLES["decode_lists"] = """WITH k AS (SELECT p_name, count(DISTINCT p_brand) AS n FROM part WHERE p_name NOT LIKE 'blue%' GROUP BY ALL), w AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, sum((coalesce(n, 0) = 1)::INT)::BIGINT AS n_hit, sum((coalesce(n, 0) > 1)::INT)::BIGINT AS n_doubt, sum((n IS NULL)::INT)::BIGINT + 1 AS n_miss FROM w LEFT JOIN k USING (p_name) GROUP BY ALL"""
ORACLES["global_search"] = f"""WITH {ORDERS}, r AS (SELECT 'product' AS kind, product_id AS id, name FROM items UNION ALL SELECT 'component', p_partkey, p_name FROM part),
t AS (SELECT *, CASE WHEN lower(name) = 'ring' THEN 0 WHEN lower(name) LIKE 'ring%' THEN 1 ELSE 2 END AS tier FROM r WHERE lower(name) LIKE '%ring%')
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY kind ORDER BY tier, length(name), id) <= 8"""
ORACLES["question_items"] = f"""WITH {ASSERTIONS}, p AS (SELECT ingredient_id, family, list(assertion_id ORDER BY assertion_id) FILTER (level IN ('human_rct', 'human_ct', 'human_open')) AS cite FROM assertions GROUP BY ALL)
SELECT ingredient_id, family, 'fact_check' AS kind, array_to_string(cite, ',') AS must_cite FROM p WHERE cite IS NOT NULL
UNION ALL SELECT ingredient_id, family, 'refusal', '' FROM p WHERE cite IS NULL AND ingredient_id NOT IN (SELECT ingredient_id FROM p WHERE cite IS NOT NULL)"""
ORACLES["evidence_coverage"] = f"""WITH {ASSERTIONS}, {O}, h AS (SELECT DISTINCT ingredient_id FROM assertions WHERE level IN ('human_rct', 'human_ct', 'human_open'))
SELECT product_id, round(avg((h.ingredient_id IS NOT NULL)::INT), 4) AS coverage FROM links LEFT JOIN h USING (ingredient_id) GROUP BY ALL"""
ORACLES["effect_union"] = f"WITH {ASSERTIONS} SELECT ingredient_id, array_to_string(list_sort(list(DISTINCT effect)), '|') AS effects FROM assertions GROUP BY ALL"
ORACLES["price_quartiles"] = f"""WITH {ORDERS}, s AS (SELECT brand, list(price ORDER BY price) AS v, count(*) AS n FROM items GROUP BY ALL), q AS (SELECT *, unnest([1, 2, 3]) AS q FROM s), l AS (SELECT *, least(greatest((n + 1) * q // 4, 1), n - 1) AS low FROM q),
x AS (SELECT brand, q, round(v[low] + (v[low + 1] - v[low]) * ((n + 1) * q - low * 4) / 4, 4) AS y FROM l)
SELECT brand, max(y) FILTER (q = 1) AS q1, max(y) FILTER (q = 2) AS q2, max(y) FILTER (q = 3) AS q3 FROM x GROUP BY ALL"""
ORACLES["event_windows"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(avg(value), 4) AS avg_value, max(value) AS max_value FROM events GROUP BY ALL"
