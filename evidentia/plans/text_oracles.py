"""DuckDB SQL for the expressions over texts of the given tables."""

from __future__ import annotations

from evidentia.functions import text as t
from evidentia.plans import text_queries as q
from evidentia.plans.oracles import ASSERTIONS, ORACLES, RULES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_ADDED = ", ".join(f"(-1, '理肤泉', {k}, {_text(x)})" for k, x in enumerate(q.ADDED))
LINES = f"""d AS (SELECT doc_id, source, string_split(replace(coalesce(text, ''), 'ß', 'ss'), chr(10)) AS l FROM documents
), r AS (SELECT doc_id, source, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM d UNION ALL SELECT * FROM (VALUES {_ADDED}))"""
_LIST = lambda names: ", ".join(f"'{x}'" for x in names)
_DEPTH = """list_reduce(list_prepend(0, list_transform(string_split(line, ''), lambda c: CASE WHEN c IN ('(', '[') THEN 1 WHEN c IN (')', ']') THEN 2 WHEN c = '/' THEN 3 ELSE 0 END)),
    lambda a, x: CASE WHEN x = 1 THEN a + 2 WHEN x = 2 AND a >= 2 THEN a - 2 WHEN x = 3 AND a >= 2 AND a % 2 = 0 THEN a + 1 ELSE a END) % 2 = 1"""
ORACLES["names_in_lines"] = rf"""WITH {LINES}, b AS (SELECT *, regexp_replace(upper(line), '[.\s]', '', 'g') AS bare, list_filter(regexp_split_to_array(upper(line), '[^A-Z]+'), lambda x: x <> '') AS caps FROM r)
SELECT doc_id, line_no::INT AS line_no, bare, bare IN ({_LIST(t.ALCOHOLS)}) OR coalesce(source IN ({_LIST(t.ALCOHOLS)}), false) AS alcohol, bare IN ({_LIST(t.ACIDS)}) OR coalesce(source IN ({_LIST(t.ACIDS)}), false) AS acid,
  regexp_matches(bare, '{t.FRAGRANCES}') OR coalesce(contains(source, '{t.FRAGRANCE_CN}'), false) AS fragrance,
  CASE WHEN len(caps) > 0 AND len(list_filter(caps, lambda x: x NOT IN ({_LIST(t.WATER_NAMES)}))) = 0 THEN 'WATER' ELSE line END AS water, trim(regexp_split_to_array(line, '[（(]')[1]) AS stem,
  coalesce(nullif(regexp_replace(line, '[^一-龥]', '', 'g'), ''), line) AS brand_group, coalesce(nullif(regexp_extract(line, '[一-龥]+'), ''), trim(line)) AS brand_head,
  coalesce(trim(line) <> '' AND trim(source) <> '' AND (contains(trim(line), trim(source)) OR contains(trim(source), trim(line))), false) AS same_brand,
  CASE WHEN regexp_matches(source, '[一-龥]') THEN trim(regexp_replace(source, '\s+', ' ', 'g')) ELSE 'INCI:' || trim(upper(line)) END AS component_key,
  array_to_string(list_filter([trim(upper(line)), regexp_replace(trim(upper(line)), '\.+$', ''), trim(upper(line)) || '.'], lambda x, i: i = 1 OR (i = 2 AND x <> trim(upper(line))) OR (i = 3 AND true)), '|') AS official_keys,
  regexp_matches(upper(line), '{t.MIXTURE_PARTS}') OR upper(line) IN ({_LIST(t.MIXTURE_NAMES)}) AS mixture_part, list_has_any(regexp_split_to_array(trim(upper(line)), '\s+'), [{_LIST(t.MIXTURE_WORDS)}]) AS mixture_word,
  {_DEPTH} AS slash_inside, regexp_replace(upper(line), '[^A-Z0-9一-鿿]+', '', 'g') AS collapsed FROM b"""
_ONCE = lambda x: f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"
_UNITS = "list_reduce(list_prepend([]::BIGINT[], list_transform(list_filter(string_split(line, ''), lambda c: c <> ''), lambda c: CASE WHEN ord(c) >= 65536 THEN [55296 + (ord(c) - 65536) // 1024, 56320 + (ord(c) - 65536) % 1024]::BIGINT[] ELSE [ord(c)]::BIGINT[] END)), lambda a, x: list_concat(a, x))"
ORACLES["notes_in_lines"] = rf"""WITH {LINES}, p AS (
  SELECT *, list_transform(regexp_split_to_array(line, '[、，,；;\n]'), lambda x: trim(x)) AS parts, list_transform(regexp_extract_all(line, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE)[1:2] AS numbers,
    list_transform(string_split(lower(line), ','), lambda x: trim(x)) AS tokens, {_UNITS} AS units, {RULES.format(e="source")} AS family FROM r
), s AS (SELECT *, list_filter(parts, lambda x: regexp_full_match(x, '[一-龥]{{2,8}}')) AS short, list_filter(parts, lambda x: x <> '') AS full_parts, list_reduce(list_prepend(5381::BIGINT, units), lambda h, x: (h * 33 + x) & 4294967295) AS h FROM p
), u AS (SELECT *, CASE WHEN family <> '其他' THEN list_prepend(source, short) ELSE short END AS named FROM s)
SELECT doc_id, line_no::INT AS line_no, array_to_string(list_filter(parts, lambda x: regexp_matches(x, '[A-Za-z]')), '|') AS latin, array_to_string({_ONCE("named")}, '|') AS phrases, (len(full_parts) - len(short))::INT AS skipped,
  array_to_string({_ONCE("short")}, '|') AS effects, array_to_string(list_filter(tokens, lambda x: x <> ''), '|') AS listed,
  try_cast(replace(regexp_extract(line, '(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)', 1), ',', '') AS DOUBLE) AS price,
  CASE WHEN NOT contains(line, '=') THEN list_min(numbers) END AS low, CASE WHEN NOT contains(line, '=') THEN list_max(numbers) END AS high, nullif(regexp_extract(line, '(?i)(?:pubmed\.ncbi\.nlm\.nih\.gov/|PMID[:：]?\s*)(\d+)', 1), '') AS paper,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(line, '\[(\d{{1,3}})\]', 1), lambda x: x::INT))), ',') AS cited, regexp_matches(line, '\d+(?:\.\d+)?\s*%') AND NOT regexp_matches(line, '{t.HEDGES}') AS needs_hedge,
  CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS key, regexp_replace(printf('%.10f', length(line) / 8.0::DOUBLE), '\.?0+$', '') AS number FROM u"""
ORACLES["texts_unwrapped"] = r"""WITH c AS (SELECT doc_id, regexp_replace(trim(coalesce(text, '')), '[ \t]*\n[ \t]*', chr(10), 'g') AS a FROM documents),
j AS (SELECT doc_id, replace(replace(a, '-' || chr(10), '-'), chr(10), ' ') AS cell FROM c)
SELECT doc_id, length(cell)::INT AS length, md5(cell) AS digest FROM j"""
ORACLES["streams_of_turns"] = """SELECT conv_id, count(*)::INT AS n_parts, md5(string_agg(text, '|' ORDER BY turn)) AS digest, sum((role = 'user')::INT)::BIGINT AS n_user, sum(turn)::BIGINT AS turns FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"""
ORACLES["slugs_of_hosts"] = r"""WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, CASE WHEN NOT contains(url, 'page=') THEN nullif(regexp_extract(url, '/en/(\d+)', 1), '') END AS slug FROM pages WHERE url IS NOT NULL)
SELECT host, coalesce(string_agg(DISTINCT slug, ',' ORDER BY slug), '') AS slugs FROM h GROUP BY host"""
ORACLES["dates_as_written"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 4 AND month(o_orderdate) > 9 AND day(o_orderdate) > 9 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"
ORACLES["reports_of_parts"] = """SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN '真人实测' WHEN 'ECONOMY' THEN '真人实测' WHEN 'MEDIUM' THEN '实验室试验' WHEN 'LARGE' THEN '仅文献资料' ELSE '研究数据' END AS tier,
  upper(p_name || '& ' || p_brand) AS name, '{"size":' || p_size || ',"brand":"' || p_brand || '"}' AS report FROM part"""
_STAGES = r"""c AS (SELECT min(p_partkey) AS id, '料' || p_name AS cn, p_name AS inci FROM part GROUP BY p_name), q AS (
  SELECT conv_id * 1000 + turn AS qid, text || CASE (conv_id + turn) % 5 WHEN 0 THEN ' Old ' || p_name WHEN 1 THEN ' 料' || p_name WHEN 2 THEN ' ' || upper(p_name) WHEN 3 THEN ' ' || substr(p_name, 2, 4) ELSE '' END AS question
  FROM conversations JOIN part ON p_partkey = (conv_id * 7 + turn) % 200 WHERE text IS NOT NULL
), one AS (SELECT qid, id, 1 AS stage, -length(inci) - 4 AS a, instr(upper(question), 'OLD ' || upper(inci)) AS b, id AS d FROM q JOIN c ON contains(upper(question), 'OLD ' || upper(inci))
), two AS (SELECT qid, id, 2 AS stage, -CASE WHEN contains(question, cn) THEN length(cn) ELSE length(inci) END AS a, id AS b, 0 AS d FROM q JOIN c ON contains(question, cn) OR contains(upper(question), upper(inci))
), early AS (SELECT * FROM one UNION ALL SELECT * FROM two
), w AS (
  SELECT qid, generate_subscripts(l, 1) AS nth, unnest(l) AS word FROM (SELECT qid, regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9\-]+|[一-鿿]{2,8}') AS l FROM q WHERE qid NOT IN (SELECT qid FROM early))
), n AS (SELECT id, upper(cn) AS name FROM c UNION ALL SELECT id, upper(inci) FROM c
), h AS (SELECT word, id, CASE WHEN name = upper(word) THEN 1 WHEN starts_with(name, upper(word)) THEN 2 ELSE 3 END AS tier, CASE WHEN name = upper(word) THEN 0 ELSE length(name) END AS size FROM (SELECT DISTINCT word FROM w) JOIN n ON contains(name, upper(word))
), told AS (SELECT word, first(id ORDER BY tier, size, id) AS id FROM h GROUP BY word
), every AS (SELECT * FROM early UNION ALL SELECT qid, id, 3, nth, 0, 0 FROM w JOIN told USING (word)
), best AS (SELECT qid, id, stage, a, b, d FROM every QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY stage, a, b, d) = 1
), asked AS (SELECT qid AS question_id, id AS ingredient_id, stage, row_number() OVER (PARTITION BY qid ORDER BY stage, a, b, d, id)::INT AS rank FROM best)"""
ORACLES["question_components"] = f"WITH {_STAGES} SELECT question_id, ingredient_id, stage::INT AS stage, rank FROM asked WHERE rank <= 3"
ORACLES["question_evidence"] = f"""WITH {_STAGES}, {ASSERTIONS} SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank, assertion_id)::INT AS item, asked.ingredient_id AS entity_id, assertion_id AS evidence_id, effect AS text
FROM asked JOIN assertions ON assertions.ingredient_id = asked.ingredient_id WHERE rank <= 2 QUALIFY item <= 8"""
ORACLES["stub_components"] = """WITH c AS (SELECT p_partkey AS id, p_name AS inci, CASE WHEN p_partkey % 5 <> 0 THEN '成分' || p_partkey END AS cn FROM part),
n AS (SELECT p_name AS name FROM part UNION SELECT p_brand FROM part UNION SELECT '成分' || p_partkey FROM part UNION SELECT source FROM documents WHERE source IS NOT NULL),
l AS (SELECT name, (SELECT min(id) FROM c WHERE cn = name) AS a, (SELECT min(id) FROM c WHERE inci = name) AS b FROM n)
SELECT name, coalesce(a, b) AS ingredient_id, CASE WHEN a IS NOT NULL THEN 'chinese' ELSE 'name' END AS via FROM l WHERE coalesce(a, b) IS NOT NULL
UNION ALL SELECT name, (SELECT max(id) FROM c) + row_number() OVER (ORDER BY name), 'new' FROM l WHERE a IS NULL AND b IS NULL"""
_REGISTER = "r AS (SELECT (doc_id * 7 + 3)::VARCHAR AS entry, source FROM documents), n AS (SELECT entry, (row_number() OVER (ORDER BY entry) - 1) // 300 AS range_no FROM (SELECT DISTINCT entry FROM r))"
ORACLES["register_ranges"] = f"WITH {_REGISTER}, g AS (SELECT range_no, min(entry) AS low, count(*) AS n FROM n GROUP BY range_no) SELECT range_no::BIGINT AS range_no, low, lead(low) OVER (ORDER BY range_no) AS high, n FROM g"
ORACLES["register_pages"] = f"""WITH {_REGISTER}, p AS (SELECT range_no, entry, (row_number() OVER (PARTITION BY range_no ORDER BY entry) - 1) // 50 + 1 AS page_no FROM r JOIN n USING (entry))
SELECT range_no::BIGINT AS range_no, page_no::BIGINT AS page_no, count(*) AS n, min(entry) AS first FROM p GROUP BY ALL"""
ORACLES["register_completeness"] = f"WITH {_REGISTER} SELECT (SELECT count(*) FROM r) AS stated, count(*) AS rows_fetched, count(DISTINCT entry) AS unique_keys, (SELECT count(*) FROM r) = count(DISTINCT entry) AS complete FROM r WHERE source <> 'src0'"
