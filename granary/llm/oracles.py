"""DuckDB SQL for the rows of the queries that SQL can express, over documents whose doc_id is unique."""

from granary.llm import quality, substring

_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]"

_rates = """rates AS (SELECT *, CASE WHEN n_words = 0 THEN 0 ELSE n_symbols::DOUBLE / n_words END AS symbol_rate, CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines::DOUBLE / n_lines END AS dup_line_rate,
 CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words::DOUBLE / n_words END AS repeat_rate, CASE WHEN n_words = 0 THEN 0 ELSE word_chars::DOUBLE / n_words END AS word_length,
 n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)"""


def _fence(by: str) -> str:
    q = lambda m: f"quantile_disc({m}, 0.5) + greatest({quality.STATISTICS[m]}, {quality.SPREAD} * (quantile_disc({m}, 0.75) - quantile_disc({m}, 0.5)))"
    group = f"{by}, " if by else ""
    return f"SELECT {group}count(*) AS n, {', '.join(f'{q(m)} AS {m}' for m in quality.STATISTICS)} FROM rates WHERE NOT base_failed" + (f" GROUP BY {by}" if by else "")


def _pick(m: str) -> str:
    return f"CASE WHEN c.n >= {quality.LEAST_DOCS} THEN c.{m} WHEN l.n >= {quality.LEAST_DOCS} THEN l.{m} ELSE a.{m} END"


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 3) g(k) GROUP BY 1),
stats AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cover USING (doc_id)),
{_rates}, c AS ({_fence('lang, source')}), l AS ({_fence('lang')}), a AS ({_fence('')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT ({' OR '.join(f'coalesce(r.{m} > {_pick(m)}, false)' for m in quality.STATISTICS)}) AS kept
FROM rates r LEFT JOIN c USING (lang, source) LEFT JOIN l USING (lang) CROSS JOIN a
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT a AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id, coalesce(max(m), 0)::BIGINT AS n_links FROM reach LEFT JOIN n ON n.doc_id = a LEFT JOIN (SELECT a AS node, count(*) AS m FROM ways GROUP BY 1) ON node = a GROUP BY 1
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + {substring.SPAN - 1}], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.SPAN - 2})) AS i FROM w)),
firsts AS (SELECT x, min(doc_id) AS first, arg_min(i, (doc_id, i)) AS spot FROM windows GROUP BY 1),
later AS (SELECT doc_id, i, first, spot FROM windows JOIN firsts USING (x) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, {substring.SPAN}) g(k)),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY 1),
copies AS (SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS first FROM w WHERE len(w) >= {substring.SPAN}) WHERE first < doc_id),
runs AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM copies) THEN 1 ELSE count(*) END AS n FROM (SELECT *, lag(i) OVER v AS p, lag(first) OVER v AS f, lag(spot) OVER v AS q FROM later WINDOW v AS (PARTITION BY doc_id ORDER BY i)) WHERE p IS NULL OR i != p + 1 OR first != f OR spot != q + 1 GROUP BY 1),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(n, 0)::BIGINT AS n_factors
FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
