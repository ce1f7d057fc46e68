"""SQL counterparts of the queries whose result SQL can express."""

from __future__ import annotations

from . import license_scan, line_dedup

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
BLANK_WORDS = "regexp_extract_all(" + LOWER + ", '[^\\x20\\x09-\\x0D]+')"

NEAR_DEDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {BLANK_WORDS.format("text")} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), sized AS (
  SELECT s.doc_id, s.s, z.n FROM shingles s JOIN sizes z USING (doc_id)
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both
  FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared WHERE 100 * n_both >= 80 * (na + nb - n_both)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, low) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node WHERE r.low < e.b
), named AS (
  SELECT node, min(low) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, n.component_id, d.doc_id = n.component_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN named n ON n.node = d.doc_id
"""

SUFFIX_DEDUP = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, p, substr(h, 2 * p::INTEGER + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM bytes)
), firsts AS (
  SELECT s, min(doc_id) AS first_doc FROM strings GROUP BY s
), gone AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before
  FROM strings JOIN firsts USING (s) WHERE first_doc < doc_id
), marked AS (
  SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM gone
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM marked GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS is_last FROM runs
), kept AS (
  SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * from_::INTEGER + 1, 2 * (a - from_)::INTEGER), '' ORDER BY a)
      || string_agg(CASE WHEN is_last THEN substr(h, 2 * b::INTEGER + 1) ELSE '' END, '' ORDER BY a) AS k
  FROM gaps g JOIN bytes USING (doc_id) GROUP BY g.doc_id
)
SELECT b.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(k, h))) AS kept_sha256
FROM bytes b LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = f"""
WITH docs AS (
  SELECT doc_id, {WORDS.format("text")} AS w FROM documents
), items AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT item_id, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM items)
), places AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), met AS (
  SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.g = x.g
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def license_scan_sql() -> str:
    """The whole scan: grams of the templates as values, diagonals, merged parts, coverage."""
    texts = [(p, label, True) for p, label in license_scan.PHRASES.items()] + [(t, label, False) for label, t in license_scan.TEMPLATES]
    values = ", ".join(f"({n}, '{label}', {str(exact).lower()}, '{text}')" for n, (text, label, exact) in enumerate(texts))
    k, drift, least = license_scan.GRAM, license_scan.DRIFT, license_scan.COVERAGE
    return f"""
WITH templates AS (
  SELECT template, label, exact, string_split(body, ' ') AS w FROM (VALUES {values}) AS v(template, label, exact, body)
), template_grams AS (
  SELECT template, label, exact, len(w) AS size, at_, array_to_string(w[at_ + 1 : at_ + {k}], ' ') AS gram
  FROM (SELECT *, unnest(range(0, len(w) - {k - 1})) AS at_ FROM templates)
), docs AS (
  SELECT doc_id, {WORDS.format("text")} AS w FROM documents
), grams AS (
  SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {k}], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {k - 1})) AS pos FROM docs WHERE len(w) >= {k})
), met AS (
  SELECT g.doc_id, t.template, t.label, t.exact, t.size, t.at_, g.pos - t.at_ AS diagonal FROM grams g JOIN template_grams t USING (gram)
), diagonals AS (
  SELECT DISTINCT doc_id, template, exact, diagonal FROM met
), stepped AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS step FROM diagonals
), parts AS (
  SELECT doc_id, template, diagonal,
    sum(CASE WHEN step <= {drift} AND NOT exact THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM stepped
), spans AS (
  SELECT m.doc_id, m.template, any_value(m.label) AS label, any_value(m.exact) AS exact, min(m.diagonal) AS start,
    len(list_distinct(flatten(list(range(m.at_, m.at_ + {k}))))) / any_value(m.size) AS covered
  FROM met m JOIN parts p USING (doc_id, template, diagonal) GROUP BY m.doc_id, m.template, p.part
), judged AS (
  SELECT *, exact AND covered = 1.0 AS base, (exact AND covered = 1.0) OR (NOT exact AND covered >= {least}) AS found FROM spans
), per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels, max(covered) AS score
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN per_doc p ON p.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": license_scan_sql(),
        "op4_near_dedup": NEAR_DEDUP,
        "op5_suffix_dedup": SUFFIX_DEDUP,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op9_benchmark_decontamination": DECONTAMINATION,
    }
