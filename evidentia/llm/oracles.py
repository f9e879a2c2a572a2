"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

from __future__ import annotations

from evidentia.llm import hard_negatives, importance, license_scan, quality_rules

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n_points DESC, doc_id) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""


def _measures_sql() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, lang, source, {k} AS measure, {formula.replace(' div ', ' // ')} AS value FROM c WHERE NOT base_failed" for k, (formula, *_) in enumerate(quality_rules.MEASURES.values()))


def _fence_rows() -> str:
    return ", ".join(f"({k}, {width}, {slack}, {str(both).lower()})" for k, (_, width, slack, both) in enumerate(quality_rules.MEASURES.values()))


QUALITY_RULES = f"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines
  FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM t WHERE len(words) >= 5
), w AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i : i + 4], ' ')) AS n FROM p
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM w, range(5) AS _(k) WHERE n > 1 GROUP BY doc_id
), c AS MATERIALIZED (
  SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(words) < {quality_rules.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {quality_rules.MAX_REPEAT_PERCENT} * len(words) AS base_failed,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^!-/:-@\\[-`{{-~]', '', 'g')) AS n_punct,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN r USING (doc_id)
), m AS ({_measures_sql()}
), e AS (
  SELECT *, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS edge FROM m
), l AS (
  SELECT level, CASE WHEN level < 2 THEN lang ELSE '' END AS of_lang, CASE WHEN level < 1 THEN source ELSE '' END AS of_source, measure, edge FROM e, range(3) AS _(level)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY level, of_lang, of_source, measure ORDER BY edge) AS rn, count(*) OVER (PARTITION BY level, of_lang, of_source, measure) AS total FROM l
), q AS MATERIALIZED (
  SELECT level, of_lang, of_source, measure, max(edge) FILTER (rn = (total + 3) // 4) AS q1, max(edge) FILTER (rn = (3 * total + 3) // 4) AS q3
  FROM o WHERE total >= {quality_rules.MIN_GROUP} GROUP BY ALL
), a AS (
  SELECT lang, source, min(level) AS level FROM (SELECT DISTINCT lang, source FROM c), (SELECT DISTINCT level, of_lang, of_source FROM q)
  WHERE (level = 2 OR lang = of_lang) AND (level > 0 OR source = of_source) GROUP BY ALL
), b AS (SELECT *, lag(edge) OVER (PARTITION BY level, of_lang, of_source, measure ORDER BY edge) AS before FROM (SELECT DISTINCT level, of_lang, of_source, measure, edge FROM l)
), v AS (SELECT * FROM (VALUES {_fence_rows()}) AS v(measure, width, slack, both_sides)
), s AS (
  SELECT level, of_lang, of_source, measure, first((edge + before) // 2 ORDER BY edge) AS middle FROM b JOIN q USING (level, of_lang, of_source, measure) JOIN v USING (measure) WHERE edge > q3 + slack AND 2 * edge > 3 * before GROUP BY ALL
), f AS (
  SELECT lang, source, measure, q1 - width * (q3 - q1) - slack AS low, CASE WHEN q3 > q1 THEN q3 + width * (q3 - q1) + slack ELSE coalesce(middle, {quality_rules.NO_FENCE}) END AS high, both_sides
  FROM a JOIN q ON a.level = q.level AND (a.level = 2 OR lang = of_lang) AND (a.level > 0 OR source = of_source) JOIN v USING (measure)
  LEFT JOIN s ON s.level = q.level AND s.of_lang = q.of_lang AND s.of_source = q.of_source AND s.measure = q.measure
), bad AS (
  SELECT DISTINCT doc_id FROM m JOIN f USING (lang, source, measure) WHERE value > high OR (both_sides AND value < low)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM c
"""


def _template_rows(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"({k}, '{label}', string_split('{text}', ' '))" for k, (text, label) in enumerate(rows))


_G = license_scan.GRAM
LICENSE_SCAN = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), phrase(template, label, t) AS (VALUES {_template_rows(license_scan.PHRASES)}
), notice(template, label, t) AS (VALUES {_template_rows(license_scan.NOTICES)}
), place AS (
  SELECT doc_id, i, label FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d) JOIN phrase ON words[i] = t[1] AND words[i : i + len(t) - 1] = t
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM place GROUP BY doc_id
), gram AS (
  SELECT doc_id, i, words[i : i + {_G - 1}] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {_G - 2})) AS i FROM d WHERE len(words) >= {_G})
), t_gram AS (
  SELECT template, label, len(t) AS t_words, j, t[j : j + {_G - 1}] AS g FROM (SELECT *, unnest(range(1, len(t) - {_G - 2})) AS j FROM notice)
), hit AS (
  SELECT doc_id, template, label, t_words, i, j, i - j AS diagonal FROM gram JOIN t_gram USING (g)
), gap AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, j) > {license_scan.MAX_SHIFT}, true)::INT AS apart FROM hit
), grouped AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal, j ROWS UNBOUNDED PRECEDING) AS span FROM gap
), span AS (
  SELECT doc_id, template, label, count(DISTINCT j) AS covered, count(DISTINCT j) / (t_words - {_G - 1}) AS cover, min(i) AS first, max(i) + {_G} AS last, t_words FROM grouped GROUP BY doc_id, template, label, t_words, span
), enough AS (
  SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM span WHERE cover >= {license_scan.LEAST_COVER} AND last - first <= {license_scan.MOST_STRETCH} * t_words
), clustered AS (
  SELECT *, sum(coalesce(first >= before, true)::INT) OVER (PARTITION BY doc_id ORDER BY first, last, template ROWS UNBOUNDED PRECEDING) AS cluster FROM enough
), verified AS (
  SELECT doc_id, label, cover FROM clustered QUALIFY covered = max(covered) OVER (PARTITION BY doc_id, cluster)
), every AS (
  SELECT doc_id, label, 1.0::DOUBLE AS score FROM place UNION ALL SELECT doc_id, label, cover FROM verified
), named AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score FROM every GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_B = importance.BUCKETS
#: CRCs of distinct words, byte by byte from hexadecimal digits, by the table of the polynomial.
IMPORTANCE = rf"""
WITH tbl AS (
  SELECT list(list_reduce(list_concat([i::BIGINT], range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor({importance.POLYNOMIAL}::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS _(i)
), d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), b AS (
  SELECT list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), dw AS (SELECT doc_id, unnest(words) AS w FROM d
), bw AS (SELECT unnest(words) AS w FROM b
), word AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), crc AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % {_B} AS bucket FROM word, tbl
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM s)::DOUBLE + {_B}) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + {_B}))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), w AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY doc_id
), u AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (list_reduce(list_concat([0::BIGINT], list_transform(range(1, 9), lambda i: instr('0123456789abcdef', sha256('{importance.SEED}:' || doc_id)[i]) - 1)), lambda a, x: a * 16 + x) + 0.5::DOUBLE) / 4294967296 AS u
  FROM d LEFT JOIN w USING (doc_id)
), scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM u
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {importance.LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * {importance.PERCENT} // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

_H = hard_negatives
HARD_NEGATIVES = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % {_H.RELABEL_EVERY} = 0 THEN (label + 1) % {_H.LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({_H.SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % {_H.ANCHOR_EVERY} = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {_H.POSITIVES}
), n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE label <> own AND {_H.LOW} * positive_score <= 100 * score AND 100 * score <= {_H.HIGH} * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {_H.NEGATIVES}
"""

ORACLES = {
    "op4_exact_dedup": EXACT_DEDUP,
    "op6_quality_rules": QUALITY_RULES,
    "op10_license_scan": LICENSE_SCAN,
    "op11_importance_resampling": IMPORTANCE,
    "op13_hard_negatives": HARD_NEGATIVES,
}
