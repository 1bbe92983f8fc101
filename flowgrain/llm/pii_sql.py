"""SQL twin of the personal data query."""

from __future__ import annotations

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
     "list_bool_and(list_transform(string_split(value, '.'), lambda p: length(ltrim(p, '0')) <= 3 "
     "AND coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) <= 255))"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+",
     "length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: "
     "CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INTEGER) "
     "WHEN CAST(reverse(digits)[i] AS INTEGER) > 4 THEN 2 * CAST(reverse(digits)[i] AS INTEGER) - 9 "
     "ELSE 2 * CAST(reverse(digits)[i] AS INTEGER) END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
)


def _placed(source: str, pattern: str, rest: str) -> str:
    """Matches of a pattern with their code point places."""
    return f"""
SELECT doc_id, text, {rest}, f[i] AS value,
  (list_sum(list_transform(g[1:i], lambda x: length(x)))
   + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (
  SELECT *, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS g
  FROM {source} WHERE regexp_matches(text, '{pattern}')))"""


def _words(text: str) -> str:
    return (f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), "
            "lambda w: w <> '')")


PII_SQL = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\nbase AS (" + " UNION ALL ".join(
    f"SELECT doc_id, text, kind, k, value, digits, a, a + length(value) AS b FROM (SELECT *, "
    f"regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM ({_placed('d', p, f'''{k} AS k, '{kind}' AS kind''')}))\n"
    f"WHERE {good}" for k, (kind, p, good) in enumerate(_KINDS)) + f"""),
seen AS (
  SELECT doc_id, entity, list_sort(list_distinct(list_concat(left_words[-6:], right_words[:6]))) AS terms
  FROM (SELECT doc_id, kind || ':' || CASE kind WHEN 'email' THEN lower(value) WHEN 'ip' THEN value ELSE digits END AS entity,
      {_words("substring(text, 1, a)")} AS left_words,
      {_words("substring(text, b + 1)")} AS right_words FROM base)),
contexts AS (SELECT DISTINCT entity, terms FROM seen),
pairs AS (SELECT entity, term, count(*) AS both_n FROM (SELECT entity, unnest(terms) AS term FROM contexts)
  GROUP BY ALL HAVING count(*) >= 2),
alone AS (SELECT entity, count(*) AS entity_n FROM contexts GROUP BY entity HAVING count(*) >= 2),
held AS (SELECT term, count(*) AS term_n FROM (SELECT unnest(list_distinct({_words("text")})) AS term FROM (SELECT DISTINCT text FROM d)) GROUP BY term),
rated AS (
  SELECT entity, term FROM pairs JOIN alone USING (entity) JOIN held USING (term), (SELECT count(DISTINCT text) AS n FROM d)
  WHERE n > entity_n AND ln(n * both_n / (entity_n * term_n)) / ln(n / entity_n) >= 0.8),
own AS (
  SELECT doc_id, list(DISTINCT term) AS terms
  FROM (SELECT doc_id, entity, unnest(terms) AS term FROM seen) JOIN rated USING (entity, term) GROUP BY doc_id),
named AS (SELECT d.doc_id, text, terms FROM d JOIN own USING (doc_id)),
term_spans AS (SELECT doc_id, 'term' AS kind, 4 AS k, a, a + length(value) AS b
  FROM ({_placed("named", "[\\p{L}\\p{N}]+", "terms")}) WHERE list_contains(terms, lower(value))),
both_kinds AS (SELECT doc_id, kind, k, a, b FROM base UNION ALL SELECT doc_id, kind, k, a, b FROM term_spans),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(concat_ws(':', kind, a, b), ',' ORDER BY k, a) FILTER (k < 4) AS base_spans,
    string_agg(concat_ws(':', kind, a, b), ',' ORDER BY k, a) AS spans
  FROM both_kinds GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)
"""
