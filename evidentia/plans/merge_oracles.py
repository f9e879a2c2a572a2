"""DuckDB SQL for the queries over bilingual names and duplicate items."""

from __future__ import annotations

from evidentia.operators import bilingual as b
from evidentia.plans import merge_queries as q
from evidentia.plans.oracles import ORACLES

_FORMS = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(q.WRITTEN)).replace("\\\\", "\\")
WRITTEN = f"""parts AS (
  SELECT p_partkey, p_partkey::VARCHAR AS k, upper(p_name) AS a, upper(split_part(p_name, ' ', 1)) AS w1, upper(split_part(p_name, ' ', 2)) AS w2, p_type || '-' || p_size AS t, (10000 + p_size)::VARCHAR AS c FROM part
), written AS (SELECT *, CASE p_partkey % {len(q.WRITTEN)} {_FORMS} END AS name FROM parts)"""
REGISTER = """entries AS (
  SELECT DISTINCT key, cn FROM (SELECT a AS key, '料' || a AS cn FROM parts UNION ALL SELECT t, '型' || t FROM parts UNION ALL SELECT 'CI ' || c, 'CI ' || c FROM parts UNION ALL SELECT w2 || ' DENAT.', '变' || w2 FROM parts
    UNION ALL SELECT w1 || ' (' || w2 || ') BUTTER', '脂' || a FROM parts UNION ALL SELECT 'HYDROLYZED ' || a, '水解' || a FROM parts UNION ALL SELECT a || ' BIS', '料' || a FROM parts)
), alias AS (SELECT DISTINCT 'OLD ' || a AS alias, a AS key FROM parts)"""
_FOLD = r"regexp_replace(upper({x}), '[^A-Z0-9一-鿿]+', '', 'g')"
_BARE = r"trim(regexp_replace({x}, '\s*(\([^()]*\)|\[[^\[\]]*\])', '', 'g'))"
#: Entries by the six forms of a name, best first.
LOOKUP = f"""forms AS (
  SELECT key AS form, 1 AS tier, key, cn FROM entries UNION ALL SELECT regexp_replace(key, '\\.$', ''), 2, key, cn FROM entries WHERE key LIKE '%.' UNION ALL SELECT key || '.', 3, key, cn FROM entries
), bared AS (SELECT {_BARE.format(x="key")} AS form, min(key) AS key, min(cn) AS cn FROM entries WHERE {_BARE.format(x="key")} <> key GROUP BY 1 HAVING count(DISTINCT cn) = 1
), folded AS (SELECT {_FOLD.format(x="key")} AS form, min(key) AS key, min(cn) AS cn FROM entries GROUP BY 1 HAVING count(DISTINCT cn) = 1)"""


def looked_up(asked: str, name: str = "looked") -> str:
    """CTE `name`: asked with key and cn of what the register knows it as; asked: a query of one column, asked."""
    up = r"trim(regexp_replace(upper(asked), '\s+', ' ', 'g'))"
    return f"""{name}_asked AS (SELECT DISTINCT asked, {up} AS n FROM ({asked}) WHERE asked IS NOT NULL
), {name} AS (
  SELECT asked, first(key ORDER BY tier, key) AS key, first(cn ORDER BY tier, key) AS cn FROM (
    SELECT asked, tier, key, cn FROM {name}_asked JOIN forms ON form = n
    UNION ALL SELECT asked, 4, key, cn FROM {name}_asked JOIN entries ON key = {_BARE.format(x="n")} WHERE {_BARE.format(x="n")} <> n
    UNION ALL SELECT asked, 5, key, cn FROM {name}_asked JOIN bared ON form = {_BARE.format(x="n")}
    UNION ALL SELECT asked, 6, key, cn FROM {name}_asked JOIN folded ON form = {_FOLD.format(x="n")}
  ) GROUP BY asked
)"""


_CODE = r"\s*\(((?:CODE )?F\.I\.L\.:? [^()]*)\)\s*$"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(replace({x}, '®', ''), '\', 1), '\s*\[\s*\]\s*$', ''), '\s*<\s*\d+(\.\d+)?\s*%\s*$', ''), '[\s*^]*[*^]+$', ''), '^[*^\s]+', ''), '\s+', ' ', 'g'))"
_WORDS = "list_filter(list_distinct(regexp_extract_all(upper({x}), '[A-Z0-9][A-Z0-9-]*')), lambda w: length(w) >= 3 AND regexp_matches(w, '[A-Z]') AND NOT list_contains([" + ", ".join(f"'{x}'" for x in b.FORM_WORDS) + "], w))"
_CLASSES = "CASE list_last(string_split(trim(upper({x})), ' ')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in b.FORM_CLASS.items()) + " ELSE '' END"
_GUARD = f"""NOT (len(string_split(o, ' ')) < len(string_split(hk, ' ')) AND string_split(hk, ' ')[1 : len(string_split(o, ' '))] = string_split(o, ' '))
    AND NOT (regexp_matches(o, '{b.TWO_LATIN_WORDS}') AND NOT list_contains([{", ".join(f"'{x}'" for x in b.FORM_WORDS)}], list_last(string_split(o, ' '))))
    AND len(list_intersect({_WORDS.format(x="o")}, {_WORDS.format(x="hk")})) < 2
    AND NOT (len(list_intersect({_WORDS.format(x="o")}, {_WORDS.format(x="hk")})) = 0 AND {_CLASSES.format(x="o")} <> {_CLASSES.format(x="hk")})"""
#: name, resolved, rule: the rules, each as its own table, the first that has the name wins.
RESOLVED = rf"""n0 AS (SELECT DISTINCT name, {_CLEAN.format(x="name")} AS w FROM written
), n AS (
  SELECT name, trim(regexp_replace(w, '{_CODE}', '', 'i')) AS s, regexp_matches(w, '(?i){_CODE}') AS fil, regexp_extract(trim(regexp_replace(w, '{_CODE}', '', 'i')), '{b.LAST_PARENTHESES}', 1) AS main,
    regexp_extract(trim(regexp_replace(w, '{_CODE}', '', 'i')), '{b.LAST_PARENTHESES}', 2) AS inner_, regexp_replace(trim(regexp_replace(w, '{_CODE}', '', 'i')), '^CL\s+(\d+.*)$', 'CI \1') AS twice FROM n0
), m AS (
  SELECT name, s, fil, twice, regexp_matches(s, '^CL\s+\d') AS mistyped, CASE WHEN regexp_matches(s, '^[^(]*/') THEN list_filter(list_transform(string_split(s, '/'), lambda x: trim(x)), lambda x: x <> '') END AS parts,
    nullif(regexp_extract(twice, '{b.NUMBER_AND_NAME}', 1), '') AS num, nullif(regexp_extract(twice, '{b.NUMBER_AND_NAME}', 2), '') AS second,
    CASE WHEN NOT regexp_matches(s, '^[^(]*/') AND main <> '' AND NOT regexp_matches(main, '{b.COMPOSED}') THEN trim(main) END AS main, trim(inner_) AS inner_ FROM n
), x AS (
  SELECT *, CASE upper(inner_) WHEN 'HYDROLYZED' THEN 'HYDROLYZED ' || main WHEN 'HYDROLYSED' THEN 'HYDROLYZED ' || main WHEN 'FERMENTED' THEN main || ' FERMENT' END AS process,
    CASE WHEN main IS NOT NULL AND contains(inner_, ' ') THEN main || ' (' || split_part(inner_, ' ', 1) || ') ' || array_to_string(string_split(inner_, ' ')[2:], ' ') END AS shifted FROM m
), {looked_up("SELECT s AS asked FROM x WHERE s LIKE '%.' UNION SELECT twice FROM x UNION SELECT num FROM x UNION SELECT second FROM x UNION SELECT unnest(parts) FROM x UNION SELECT main FROM x UNION SELECT inner_ FROM x WHERE main IS NOT NULL UNION SELECT process FROM x UNION SELECT shifted FROM x")},
seg AS (
  SELECT name, i, part, key, cn FROM (SELECT name, parts, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM x WHERE len(parts) >= 2 AND NOT regexp_matches(s, '\bP[PE]G-\d')) LEFT JOIN looked ON asked = part
), firsts AS (SELECT name, min(i) AS i, first(part ORDER BY i) AS part, key, first(cn) AS cn FROM seg WHERE key IS NOT NULL GROUP BY name, key
), chosen AS (SELECT name, first(key ORDER BY regexp_matches(key, '^CI \d+$'), i) AS key, first(part ORDER BY regexp_matches(key, '^CI \d+$'), i) AS part, count(*) AS n, count(DISTINCT cn) AS n_cn FROM firsts GROUP BY name
), clash AS (SELECT DISTINCT name FROM firsts f JOIN chosen c USING (name) WHERE f.key <> c.key AND len(list_intersect({_WORDS.format(x="f.part")}, {_WORDS.format(x="c.part")})) > 0
), seen AS (SELECT name, count(*) AS n_parts, count(key) AS n_known, max(key) AS hk, upper(max(part) FILTER (key IS NULL)) AS o FROM seg GROUP BY name
), rules AS (
  SELECT name, 0 AS step, s AS resolved, NULL AS rule FROM x JOIN entries ON key = upper(s)
  UNION ALL SELECT name, 1, key, 'usan-alias' FROM x JOIN alias ON alias = upper(s)
  UNION ALL SELECT name, 2, min(key), 'usan-alias-collapse' FROM x JOIN alias ON {_FOLD.format(x="alias")} = {_FOLD.format(x="s")} GROUP BY name HAVING count(DISTINCT alias) = 1
  UNION ALL SELECT name, 3, key, NULL FROM x JOIN looked ON asked = s WHERE s LIKE '%.'
  UNION ALL SELECT name, 4, key, 'cl-typo' FROM x JOIN looked ON asked = twice WHERE mistyped
  UNION ALL SELECT name, 5, l2.key, CASE WHEN mistyped THEN 'cl-typo+ci-dual' ELSE 'ci-dual' END FROM x JOIN looked l1 ON l1.asked = num JOIN looked l2 ON l2.asked = second WHERE l1.key <> l2.key AND NOT regexp_matches(second, '{b.COMPOSED}')
  UNION ALL SELECT name, 6, key, 'punct-collapse' FROM x JOIN folded ON form = {_FOLD.format(x="s")} WHERE NOT regexp_matches(s, '[(\[]')
  UNION ALL SELECT name, 7, hk, 'slash-one' FROM seen WHERE n_parts = 2 AND n_known = 1 AND {_GUARD}
  UNION ALL SELECT name, 8, chosen.key, CASE WHEN chosen.n = 1 THEN 'slash-same' WHEN n_cn = 1 THEN 'slash-same-cn' ELSE 'slash-ambiguous' END FROM chosen JOIN seen USING (name)
    WHERE n_known >= 2 AND (chosen.n = 1 OR n_cn = 1 OR regexp_matches(chosen.key, '^CI \d+$') OR name NOT IN (SELECT name FROM clash))
  UNION ALL SELECT name, 9, s, NULL FROM x WHERE parts IS NOT NULL
  UNION ALL SELECT name, 10, coalesce(key, s), CASE WHEN key IS NOT NULL THEN 'paren-process' END FROM x LEFT JOIN looked ON asked = process WHERE process IS NOT NULL
  UNION ALL SELECT name, 11, key || ' [NANO]', 'paren-nano' FROM x JOIN looked ON asked = main WHERE upper(inner_) = 'NANO'
  UNION ALL SELECT name, 12, CASE WHEN l1.key LIKE 'CI %' AND l2.key NOT LIKE 'CI %' THEN l2.key ELSE l1.key END, 'paren-ambiguous' FROM x JOIN looked l1 ON l1.asked = main JOIN looked l2 ON l2.asked = inner_ WHERE l1.key <> l2.key
  UNION ALL SELECT name, 13, key, 'paren-main' FROM x JOIN looked ON asked = main
  UNION ALL SELECT name, 14, key, 'paren-inner' FROM x JOIN looked ON asked = inner_ WHERE main IS NOT NULL AND NOT regexp_matches(key, '^CI \d+$')
  UNION ALL SELECT name, 15, key, 'paren-shift' FROM x JOIN looked ON asked = shifted WHERE contains(key, '(')
  UNION ALL SELECT name, 16, s, NULL FROM x
), resolved AS (
  SELECT name, arg_min(resolved, step) AS resolved, nullif(concat_ws('+', CASE WHEN fil THEN 'fil' END, first(rule ORDER BY step)), '') AS rule FROM rules JOIN x USING (name) GROUP BY name, fil
)"""
BASE = f"WITH {WRITTEN}, {REGISTER}, {LOOKUP}, {RESOLVED}"
ORACLES["bilingual_names"] = f"{BASE} SELECT p_partkey, name, resolved, rule FROM written JOIN resolved USING (name)"
_HAS = "regexp_matches(coalesce({x}, ''), '[一-龥]')"
MERGED = rf"""comp AS (SELECT p_partkey AS id, name, CASE WHEN p_partkey % 9 = 0 THEN '名' || a || ' []' WHEN p_partkey % 9 < 4 THEN name END AS cn_name, resolved, upper(resolved) AS rkey FROM written JOIN resolved USING (name)
), keep AS (
  SELECT rkey, first(id ORDER BY upper(name) <> rkey, id) AS ingredient_id, first(resolved ORDER BY id) AS inci_name, list(cn_name ORDER BY upper(name) <> rkey, id)[1] AS own_cn,
    first(cn_name ORDER BY id) FILTER ({_HAS.format(x="cn_name")}) AS chinese, count(*) - 1 AS n_merged FROM comp GROUP BY rkey
), cleaned AS (SELECT *, {_CLEAN.format(x="inci_name")} AS clean, CASE WHEN {_HAS.format(x="own_cn")} OR chinese IS NULL THEN own_cn ELSE chinese END AS cn0 FROM keep
), {looked_up("SELECT clean AS asked FROM cleaned", "again")},
filled AS (SELECT cleaned.*, again.key AS rk, again.cn AS rcn, NOT {_HAS.format(x="cn0")} AND again.cn IS NOT NULL AS by_register FROM cleaned LEFT JOIN again ON asked = clean
), named AS (SELECT *, CASE WHEN by_register THEN rcn ELSE coalesce(cn0, '') END AS cn1 FROM filled
), final AS (
  SELECT ingredient_id, inci_name, n_merged, rkey, rk, by_register AND rcn IS DISTINCT FROM cn0 AS filled, CASE WHEN {_HAS.format(x="cn1")} THEN trim(regexp_replace(regexp_replace(cn1, '\s*\[\s*\]\s*$', ''), '[\s*^]*[*^]+$', '')) WHEN cn1 = rcn THEN cn1 ELSE inci_name END AS cn_name FROM named
)"""
ORACLES["bilingual_merged"] = f"{BASE}, {MERGED} SELECT ingredient_id, inci_name, cn_name, n_merged, filled FROM final"
LINKS = """moved AS (SELECT l_orderkey AS product_id, final.ingredient_id, l_linenumber AS position, id, id <> final.ingredient_id AS other FROM lineitem JOIN comp ON id = l_partkey JOIN final USING (rkey)
), linked AS (SELECT product_id, ingredient_id, first(position ORDER BY other, id, position) AS position FROM moved GROUP BY ALL)"""
ORACLES["bilingual_links"] = f"{BASE}, {MERGED}, {LINKS} SELECT * FROM linked"
ORACLES["bilingual_coverage"] = f"""{BASE}, {MERGED}, {LINKS}, own AS (SELECT ingredient_id, ({_HAS.format(x="cn_name")} OR rk IS NOT NULL)::BIGINT AS covered FROM final),
per AS (SELECT ingredient_id, count(*) AS n FROM linked GROUP BY ALL)
SELECT count(*) AS components, sum(covered)::BIGINT AS with_cn, sum(coalesce(n, 0))::BIGINT AS links, sum(covered * coalesce(n, 0))::BIGINT AS links_cn FROM own LEFT JOIN per USING (ingredient_id)"""

_GROUP = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in q.GROUPS.items()) + " ELSE '' END"
ITEMS = rf"""d AS (SELECT doc_id AS id, lang, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:5] AS w, {_GROUP} AS block FROM documents
), items AS (
  SELECT id, block, id % 3 = 0 AS own, CASE WHEN id % 4 = 0 THEN '品 ' || array_to_string(w, ' ') WHEN id % 7 = 1 THEN array_to_string(w, ' ') || 'x' WHEN id % 7 = 2 THEN w[1] || ' ' || array_to_string(w, ' ') WHEN id % 7 = 3 THEN array_to_string(w, ' ') || ' enriched'
    WHEN id % 7 = 4 THEN upper(array_to_string(w, ' ')) || '（page-' || id || '）' ELSE array_to_string(w, ' ') END AS name,
    CASE WHEN id % 5 = 0 THEN block || ' ' || upper(lang) WHEN id % 5 = 1 THEN upper(lang) ELSE block END AS brand FROM d
), lists AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS l, (doc_id + length(text)) % 2 = 0 AS placed FROM documents
), listed AS (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l, placed FROM lists
), keys AS (SELECT id, unnest(l) AS key, generate_subscripts(l, 1) - 1 AS place, placed FROM listed
), links AS (SELECT id, key, CASE WHEN placed AND place < 20 THEN place END AS position, placed FROM keys
), c AS (
  SELECT items.*, list_sort(l) AS keys, len(l) AS size, len(l) AS n_links, CASE WHEN placed THEN len(l) ELSE 0 END AS n_placed, regexp_matches(name, '[一-龥]') AS chinese,
    regexp_extract_all(regexp_replace(lower(name), '[（(][a-z0-9]+-[a-z0-9-]*[）)]', ' ', 'g'), '[a-z0-9]+') AS tok FROM items JOIN listed USING (id) WHERE len(l) > 0
), pairs AS (
  SELECT a.id AS a, b.id AS b, a.chinese AS ca, b.chinese AS cb, a.tok AS ta, b.tok AS tb, a.size AS sa, b.size AS sb, len(list_intersect(a.keys, b.keys)) AS shared, a.n_links AS na, b.n_links AS nb
  FROM c a JOIN c b ON a.block = b.block AND a.id <> b.id AND least(a.size, b.size) >= 11 AND abs(a.size - b.size) <= greatest(2, 0.021 * greatest(a.size, b.size)) WHERE NOT b.chinese
), m AS (SELECT *, shared / (sa + sb - shared) AS j, shared / least(sa, sb) AS inside FROM pairs
), x AS (SELECT *, round(j, 4) AS rj, round(inside, 4) AS ri FROM m WHERE ca AND abs(sa - sb) <= 2 AND inside >= 0.93 AND (j >= 0.9 OR (j >= 0.85 AND inside >= 0.96))
), ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rj DESC, ri DESC, nb DESC, b) AS of_a, row_number() OVER (PARTITION BY b ORDER BY rj DESC, ri DESC, na DESC, a) AS of_b FROM x
), crossed AS (SELECT a, b FROM ranked WHERE of_a = 1 AND of_b = 1
), near AS (
  SELECT a, b, ta, tb, list_sort(list_filter(ta, lambda x, i: len(list_filter(ta[1:i], lambda y: y = x)) > len(list_filter(tb, lambda y: y = x)))) AS la,
    list_sort(list_filter(tb, lambda x, i: len(list_filter(tb[1:i], lambda y: y = x)) > len(list_filter(ta, lambda y: y = x)))) AS lb FROM m WHERE NOT ca AND a > b AND j >= 0.98 AND least(sa, sb) >= 12
), same AS (
  SELECT a, b FROM near WHERE (len(list_filter(la, lambda x: NOT list_contains(tb, x))) = 0 AND len(list_filter(lb, lambda x: NOT list_contains(ta, x))) = 0)
    OR (len(la) = len(lb) AND len(la) <= 2 AND levenshtein(la[1], lb[1]) <= 2 AND (len(la) = 1 OR levenshtein(la[2], lb[2]) <= 2))
), edges AS (SELECT a, b FROM crossed UNION SELECT b, a FROM crossed UNION SELECT a, b FROM same UNION SELECT b, a FROM same
), reach(node, root) AS (SELECT id, id FROM items UNION SELECT b, root FROM reach JOIN edges ON node = a
), roots AS (SELECT node AS id, min(root) AS cluster_id FROM reach GROUP BY node
), n_cross AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM crossed UNION ALL SELECT b FROM crossed) GROUP BY id
), n_same AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM same UNION ALL SELECT b FROM same) GROUP BY id
), placed AS (
  SELECT items.id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY c.n_placed DESC NULLS LAST, c.n_links DESC NULLS LAST, items.own DESC, items.id)::INT AS place, coalesce(n_cross.n, 0)::BIGINT AS n_cross, coalesce(n_same.n, 0)::BIGINT AS n_same
  FROM items JOIN roots USING (id) LEFT JOIN c ON c.id = items.id LEFT JOIN n_cross ON n_cross.id = items.id LEFT JOIN n_same ON n_same.id = items.id
)"""
ORACLES["dedup_products"] = f"WITH RECURSIVE {ITEMS} SELECT * FROM placed"
ORACLES["dedup_product_links"] = f"""WITH RECURSIVE {ITEMS}, keeper AS (SELECT cluster_id, id AS keeper FROM placed WHERE place = 1), l AS (SELECT links.*, cluster_id, place, keeper FROM links JOIN placed USING (id) JOIN keeper USING (cluster_id)),
owner AS (SELECT cluster_id, min(place) AS place FROM l GROUP BY cluster_id), given AS (SELECT cluster_id, key, first(position ORDER BY place) FILTER (position IS NOT NULL) AS given FROM l GROUP BY ALL)
SELECT keeper AS id, count(*) AS n_links, count(coalesce(position, given)) AS n_placed, sum(coalesce(position, given))::BIGINT AS places FROM l JOIN owner USING (cluster_id, place) JOIN given USING (cluster_id, key) GROUP BY keeper"""
_BRANDS = f"""WITH RECURSIVE {ITEMS}, n AS (SELECT brand, count(*) AS products FROM items WHERE brand IS NOT NULL GROUP BY brand), two AS (
  SELECT brand, products, unnest([0, 1]) AS which, unnest([regexp_replace(brand, '[^一-龥]', '', 'g'), trim(regexp_replace(regexp_replace(brand, '[一-龥]', ' ', 'g'), '\\s+', ' ', 'g'))]) AS part FROM n WHERE regexp_matches(brand, '[一-龥]') AND contains(brand, ' ')
), best AS (SELECT two.brand AS brand_from, first(part ORDER BY n.products DESC, which) AS brand_to, two.products FROM two JOIN n ON n.brand = part AND part <> two.brand WHERE n.products > two.products GROUP BY two.brand, two.products)"""
ORACLES["brand_majority"] = f"{_BRANDS} SELECT * FROM best"
ORACLES["brand_normalized"] = f"{_BRANDS} SELECT coalesce(brand_to, brand) AS brand, count(*) AS products FROM items LEFT JOIN best ON brand_from = brand GROUP BY 1"
