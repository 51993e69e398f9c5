"""The registered queries in plain SQL for DuckDB, over the same tables."""

from __future__ import annotations

from shelfmark.functions import fixed
from shelfmark.operators import tfidf
from shelfmark.plans import workload as w


def words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def rounded(expression: str, digits: int) -> str:
    return f"round_even(({expression}) * 1e{digits}, 0) / 1e{digits}"


def model(prefix: str, source: str, terms: tfidf.Vocabulary) -> str:
    """CTEs of a TF-IDF model: ``{prefix}_w`` (id, term, tf, w), ``{prefix}_v`` (term, df, idf)."""
    p = prefix
    pairs = (
        f"list_transform(range(1, greatest(len(k), 1)), lambda i: k[i] || ' ' || k[i + 1])"
        if terms.ngrams == (1, 2)
        else "[]::varchar[]"
    )
    most = f" AND count(*) <= {terms.max_df} * (SELECT n FROM {p}_n)" if terms.max_df is not None else ""
    cut = f" LIMIT {terms.max_features}" if terms.max_features is not None else ""
    return f"""
{p}_d AS ({source}),
{p}_k AS (
  SELECT id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{terms.pattern}'),
         lambda t: t NOT IN ({words(terms.stop_words)})) AS k FROM {p}_d),
{p}_t AS (
  SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(k, {pairs})) AS term FROM {p}_k)
  GROUP BY id, term),
{p}_n AS (SELECT count(*) AS n FROM {p}_d),
{p}_v AS (
  SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf) AS total FROM {p}_t GROUP BY term HAVING count(*) >= {terms.min_df}{most}
    ORDER BY total DESC, term{cut}), {p}_n),
{p}_r AS (SELECT id, term, tf, tf * idf AS raw FROM {p}_t JOIN {p}_v USING (term)),
{p}_w AS (
  SELECT id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM {p}_r)"""


DOCS = "SELECT doc_id AS id, text FROM documents"

WEEKLY = """
daily AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS q
  FROM lineitem GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY day) AS rn FROM daily),
weekly AS (
  SELECT l_suppkey, CAST((rn - 1) // 7 AS INTEGER) AS bucket, max(day) AS week_end, sum(q) AS downloads
  FROM placed GROUP BY 1, 2)"""

LABELLED = """
labelled AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, coalesce(l.toxic = 1, false) AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

PLAIN = f"regexp_replace(%s, '{fixed.NOT_PROSE}', ' ', 'g')"


def trajectory(condition: str) -> str:
    return f"""
WITH {WEEKLY},
u AS (SELECT l_suppkey, week_end, downloads FROM weekly WHERE {condition}),
h AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY week_end) AS r,
         count(*) OVER (PARTITION BY l_suppkey) AS n FROM u),
m AS (
  SELECT l_suppkey, max(n) AS n, avg(downloads) FILTER (WHERE r <= n // 2) AS a,
         avg(downloads) FILTER (WHERE r > n // 2) AS b FROM h GROUP BY 1)
SELECT k.l_suppkey, coalesce(n, 0) AS points,
       CASE WHEN coalesce(n, 0) < 6 OR a = 0 THEN 'new' WHEN b / a > 1.05 THEN 'growing'
            WHEN b / a < 0.95 THEN 'declining' ELSE 'stable' END AS trajectory
FROM (SELECT DISTINCT l_suppkey FROM weekly) k LEFT JOIN m USING (l_suppkey)"""


def near_duplicates(threshold: float = w.NEAR_DUPLICATE) -> str:
    """Pairs of distinct texts, and every copy with the first of its kind."""
    return f"""
WITH {model('m', DOCS, tfidf.NEAR_DUPLICATES)},
sig AS (SELECT id, string_agg(term || ':' || tf, '|' ORDER BY term) AS s FROM m_w GROUP BY id),
rep AS (SELECT min(id) AS id, count(*) AS copies FROM sig GROUP BY s),
v AS (SELECT m_w.* FROM m_w JOIN rep USING (id)),
scored AS (
  SELECT a.id AS id_a, b.id AS id_b, {rounded('sum(a.w * b.w)', 8)} AS score
  FROM v a JOIN v b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
pairs AS (
  SELECT id_a, id_b, score, x.copies AS copies_a, y.copies AS copies_b
  FROM scored JOIN rep x ON x.id = id_a JOIN rep y ON y.id = id_b WHERE score > {threshold}
  UNION ALL
  SELECT first, id, score, 1, 1
  FROM (SELECT id, min(id) OVER (PARTITION BY s) AS first FROM sig)
  JOIN (SELECT id AS own, {rounded('sum(w * w)', 8)} AS score FROM m_w GROUP BY id) ON own = id
  WHERE id <> first AND score > {threshold})"""


def near_duplicate_rows(threshold: float = w.NEAR_DUPLICATE) -> str:
    """Every two documents above the threshold, and how many documents have the text of either."""
    return f"""
WITH {model('m', DOCS, tfidf.NEAR_DUPLICATES)},
sig AS (SELECT id, string_agg(term || ':' || tf, '|' ORDER BY term) AS s FROM m_w GROUP BY id),
kind AS (SELECT id, count(*) OVER (PARTITION BY s) AS copies FROM sig),
scored AS (
  SELECT a.id AS id_a, b.id AS id_b, {rounded('sum(a.w * b.w)', 8)} AS score
  FROM m_w a JOIN m_w b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
pairs AS (
  SELECT id_a, id_b, score, x.copies AS copies_a, y.copies AS copies_b
  FROM scored JOIN kind x ON x.id = id_a JOIN kind y ON y.id = id_b WHERE score > {threshold})"""


def page_graph() -> str:
    address = r"SELECT page_id AS id, regexp_replace(url, '[^\p{L}\p{N}]+', ' ', 'g') AS text FROM pages"
    prose = f"SELECT page_id AS id, {PLAIN % 'html'} AS text FROM pages"
    return f"""
WITH {model('a', address, tfidf.SPECIFIC)},
{model('b', prose, tfidf.PROSE)},
part AS (
  SELECT x.id AS src, y.id AS dst, {fixed.SPECIFIC_WEIGHT} * sum(x.w * y.w) AS s
  FROM a_w x JOIN a_w y ON x.term = y.term AND x.id <> y.id GROUP BY 1, 2
  UNION ALL
  SELECT x.id, y.id, {fixed.PROSE_WEIGHT} * sum(x.w * y.w)
  FROM b_w x JOIN b_w y ON x.term = y.term AND x.id <> y.id GROUP BY 1, 2),
scored AS (SELECT src, dst, {rounded('sum(s)', 8)} AS score FROM part GROUP BY 1, 2),
edges AS (
  SELECT src, dst, score FROM scored WHERE score > {fixed.NEIGHBOUR_THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= {fixed.NEIGHBOURS}),
hops AS (
  SELECT x.src, y.dst, {rounded(f'sum(x.score * y.score) * {fixed.HOP_DECAY}', 8)} AS score
  FROM edges x JOIN edges y ON x.dst = y.src AND x.src <> y.dst GROUP BY 1, 2)"""


def similar_lists() -> str:
    """CTEs of the final lists of pages: ``lists`` (src, si, n), on top of :func:`page_graph`."""
    return f"""
{page_graph()},
best AS (
  SELECT src, dst, least(max(score), 1.0) AS score FROM (
    SELECT src, dst, score FROM edges UNION ALL SELECT src, dst, score FROM hops) GROUP BY 1, 2),
ranked AS (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank, {rounded('score', 3)} AS score
  FROM best WHERE score > {fixed.NEIGHBOUR_THRESHOLD} QUALIFY rank <= {fixed.NEIGHBOURS}),
lists AS (
  SELECT src, string_agg(dst || ':' || CAST(round(score * 1000) AS BIGINT), ',' ORDER BY rank) AS si FROM ranked GROUP BY 1)"""


def catalogue_records() -> str:
    """CTEs of the records of the page catalogue: ``recs``."""
    marker = " ".join(f"WHEN {n} THEN '{m}'" for n, m in enumerate(fixed.TYPE_MARKERS[:3]))
    return f"""
{WEEKLY},
pg AS (
  SELECT page_id AS i, url, html, CASE page_id % 3 {marker} END AS marker, CASE WHEN page_id % 4 <> 0 THEN page_id % 5 END AS o
  FROM pages),
repos AS (
  SELECT n_nationkey % 5 AS o, n_nationkey % 7 AS r, n_nationkey * 10 + n_regionkey AS st, n_nationkey % 4 = 0 AS fk,
         CASE WHEN n_nationkey % 5 <> 1 THEN 1704067200 + 86400 * n_nationkey END AS pa FROM nation),
series AS (
  SELECT l_suppkey, list(CAST(floor(downloads) AS BIGINT) ORDER BY bucket) AS v FROM weekly GROUP BY 1),
halves AS (
  SELECT l_suppkey, CAST(floor(downloads) AS BIGINT) AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY bucket) AS r,
         count(*) OVER (PARTITION BY l_suppkey) AS n FROM weekly),
means AS (
  SELECT l_suppkey, max(n) AS n, avg(d) FILTER (WHERE r <= n // 2) AS a, avg(d) FILTER (WHERE r > n // 2) AS b
  FROM halves GROUP BY 1),
listed AS (
  SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN c_name END AS publisher FROM customer),
recs AS (
  SELECT i, url, html, CASE WHEN i % 2 = 0 THEN replace(marker, '{fixed.TYPE_PREFIX}', '') ELSE 'unknown' END AS t,
         coalesce('o' || pg.o, publisher, 'author ' || (i % 6)) AS p, v, n, a, b, st::BIGINT AS st, coalesce(fk, false) AS fk,
         pa::BIGINT AS pa
  FROM pg LEFT JOIN repos ON repos.o = pg.o AND repos.r = i % 7
  LEFT JOIN series ON series.l_suppkey = i LEFT JOIN means ON means.l_suppkey = i
  LEFT JOIN listed ON c_custkey = i)"""


NAMING = f"""
naming AS (
  SELECT doc_id, lang AS cluster, source, n_chars, list_distinct(regexp_split_to_array(
    regexp_replace(lower(' ' || {PLAIN % 'text'}), '[^\\p{{L}}\\s]+', '', 'g'), '\\s+')) AS ws
  FROM documents),
sizes AS (SELECT cluster, count(*) AS members FROM naming GROUP BY 1),
counted AS (
  SELECT cluster, word, count(*) AS docs FROM (SELECT cluster, unnest(ws) AS word FROM naming)
  WHERE length(word) >= 5 AND word NOT IN ({words(fixed.CLUSTER_STOP_WORDS + fixed.NAMING_STOP_WORDS)})
  GROUP BY 1, 2),
pool AS (
  SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY docs DESC, word) <= 40),
named AS (
  SELECT cluster, word, docs, CAST(row_number() OVER (PARTITION BY cluster ORDER BY docs DESC, word) AS INTEGER) AS rank
  FROM pool JOIN sizes USING (cluster)
  WHERE docs >= greatest(2, CAST(floor(members * 0.07) AS INTEGER)) AND regexp_matches(word, '^[a-z]+$')
  QUALIFY rank <= 8)"""

COHESION = """
axes AS (
  SELECT label, vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS axis FROM {source}),
unit AS (SELECT label, vec_id, axis, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS u FROM axes),
sums AS (SELECT label, axis, sum(u) AS s, sum(u * u) AS q, count(*) AS n FROM unit GROUP BY 1, 2),
tight AS (
  SELECT label, max(n) AS members,
         CASE WHEN max(n) < 2 THEN 0.0 ELSE (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) END AS cohesion
  FROM sums GROUP BY 1)"""

SAMPLED = f"""
(SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= {fixed.COHESION_SAMPLE})"""

BRANDS = """
sold AS (SELECT l_partkey, sum(l_quantity) AS downloads FROM lineitem GROUP BY 1),
members AS (SELECT p_partkey, p_name, p_brand, downloads FROM part LEFT JOIN sold ON p_partkey = l_partkey),
meta AS (
  SELECT p_brand, count(*) AS members, sum(coalesce(downloads, 0)) AS total, max(coalesce(downloads, 0)) AS top
  FROM members GROUP BY 1),
shaped AS (
  SELECT p_brand, members, total, """ + rounded("CASE WHEN total > 0 THEN top / total ELSE 0 END", 2) + """ AS ratio,
         CASE WHEN total <= 0 THEN 'long-tail' WHEN top / total > 0.019 THEN 'blockbuster'
              WHEN top / total > 0.017 THEN 'contested' ELSE 'long-tail' END AS pattern
  FROM meta)"""

MENTIONS = """
mentioned AS (
  SELECT doc_id AS id, b.text AS mentioned FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b
  ON contains(lower(d.text), lower(list_extract(string_split(b.text, '/'), -1)))
  WHERE length(list_extract(string_split(b.text, '/'), -1)) > 4)"""


def origin_lines() -> str:
    phrases = "|".join(w.ORIGIN_PHRASES)
    return f"""
lines AS (
  SELECT doc_id AS id, array_to_string(list_transform(
    list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda l: regexp_matches(l, '(?i)\\b({phrases})\\b')),
    lambda l: substring(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), 1, 200)), '|') AS origin_lines FROM documents)""".strip()


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["q01_declared_type"] = f"""
SELECT coalesce(replace(list_filter(list_transform(string_split(p_name, ' '), lambda x: 'kw-' || x),
       lambda x: x IN ({words(w.TYPE_WORDS)}))[1], 'kw-', ''), 'unknown') AS type, count(*) AS n
FROM part GROUP BY 1"""
    out["q02_top_publishers"] = """
SELECT c_name AS publisher, o_custkey, n FROM (
  SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20)
LEFT JOIN customer ON c_custkey = o_custkey"""
    out["q03_top_downloads"] = """
SELECT l_partkey, downloads, p_type FROM (
  SELECT l_partkey, sum(l_quantity) AS downloads FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
LEFT JOIN part ON p_partkey = l_partkey"""
    out["q04_distribution"] = f"""
WITH v AS (
  SELECT 'linear' AS view, value AS x FROM events
  UNION ALL SELECT 'plus_one', value + 1 FROM events
  UNION ALL SELECT 'clip_p95', least(value, (SELECT quantile_cont(value, 0.95) FROM events)) FROM events),
r AS (SELECT view, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1),
b AS (
  SELECT view, CASE WHEN hi <= lo THEN 0 ELSE least(CAST(floor((x - lo) / ((hi - lo) / 40.0)) AS INTEGER), 39) END
         AS bin, count(*) AS n FROM v JOIN r USING (view) GROUP BY 1, 2)
SELECT r.view, CAST(g.bin AS INTEGER) AS bin, {rounded('lo + g.bin * ((hi - lo) / 40.0)', 6)} AS edge,
       coalesce(b.n, 0) AS n
FROM r CROSS JOIN (SELECT unnest(range(40)) AS bin) g LEFT JOIN b ON b.view = r.view AND b.bin = g.bin"""
    out["q04b_quantiles"] = f"""
SELECT q, {rounded('x', 4)} AS x FROM (
  SELECT unnest([0.0, 0.25, 0.5, 0.95, 1.0])::double AS q,
         unnest(quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.95, 1.0])) AS x FROM lineitem)"""
    out["q05_weekly_buckets"] = f"WITH {WEEKLY} SELECT l_suppkey, bucket, week_end, downloads FROM weekly"
    out["q05b_streamed_buckets"] = out["q05_weekly_buckets"]
    out["q06_weekly_total"] = f"WITH {WEEKLY} SELECT week_end, sum(downloads) AS downloads FROM weekly GROUP BY 1"
    out["q07_weekly_grid"] = f"""
WITH {WEEKLY},
top AS (SELECT l_suppkey FROM weekly GROUP BY 1 ORDER BY sum(downloads) DESC, 1 LIMIT 15),
weeks AS (SELECT DISTINCT week_end FROM weekly),
sums AS (SELECT week_end, l_suppkey, sum(downloads) AS downloads FROM weekly GROUP BY 1, 2)
SELECT weeks.week_end, top.l_suppkey, coalesce(downloads, 0) AS downloads
FROM weeks CROSS JOIN top LEFT JOIN sums ON sums.week_end = weeks.week_end AND sums.l_suppkey = top.l_suppkey"""
    out["q08_trend_positive"] = trajectory("downloads > 0")
    out["q09_trend_all"] = trajectory("true")
    out["q10_last_26"] = f"""
WITH {WEEKLY} SELECT l_suppkey, bucket, week_end, downloads FROM weekly
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY week_end DESC) <= 26"""
    out["q11_attach_metadata"] = f"WITH {LABELLED} SELECT * FROM labelled"
    out["q11b_coverage"] = f"""
WITH {LABELLED} SELECT count(*) AS rows, count(*) FILTER (WHERE quality IS NOT NULL) AS with_label,
       count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM labelled"""
    out["q11c_top_labelled"] = f"""
WITH {LABELLED} SELECT * FROM labelled WHERE quality IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 20"""
    out["q12_freshness"] = f"""
SELECT user_id, CAST(floor(date_diff('microsecond', last_seen, TIMESTAMP '{w.AS_OF}') / 86400000000) AS INTEGER) AS days, n
FROM (SELECT user_id, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1)
WHERE days > 90 ORDER BY n DESC, user_id LIMIT 15"""
    out["q13_url_parts"] = r"""
SELECT * FROM (
  SELECT page_id, nullif(regexp_extract(url, 'example\.\w+[:/]([^/]+)/([^/#?]+)', 1), '') AS owner,
         nullif(regexp_replace(regexp_extract(url, 'example\.\w+[:/]([^/]+)/([^/#?]+)', 2), '\.html$', ''), '') AS repo,
         owner || '__' || repo AS slug FROM pages) WHERE slug IS NOT NULL"""
    out["q14_name_tokens"] = r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(string_split(name, '/')[-1],
       '^small(?:[-_]+|$)|[-_]+small$', '', 'g'), '[-_]', ' ', 'g')) AS words,
       ltrim(regexp_replace(name, '[/@]', '__', 'g'), '_') AS safe_key
FROM (SELECT p_partkey, '@' || p_brand || '/' || replace(p_name, ' ', '-') AS name FROM part)"""
    out["q15_best_label"] = f"""
SELECT c_custkey, coalesce(
  CASE WHEN c_nationkey % 5 = 0 THEN lower(c_mktsegment) END,
  CASE WHEN c_nationkey % 2 = 0 AND n_name NOT IN ({words(w.BOTS)}) THEN n_name END,
  CASE WHEN c_custkey % 3 <> 0 THEN c_name END) AS author
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"""
    hits = " + ".join(
        f"CAST(contains(lower(source), '{p}') OR contains(lower(text), '{p}') AS INTEGER)" for p in w.AUDIENCE_PHRASES
    )
    out["q16_multi_flag"] = f"""
SELECT doc_id, lang IN ({words(w.AUDIENCE_WORDS)}) OR source IN ({words(w.AUDIENCE_WORDS)}) OR {hits} >= 2 AS several
FROM documents"""
    out["q17_compact"] = """
SELECT doc_id AS n, substring(text, 1, 200) AS d, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'unknown' END AS t,
       CASE WHEN lang IN ('en', 'fr') THEN source ELSE lang || ',' || source END AS kw,
       replace(substring(text, 1, 200), chr(10), ' ') AS rm, n_chars AS dl, quality AS st,
       coalesce(toxic = 1, false) AS fk
FROM documents LEFT JOIN labels USING (doc_id)"""
    phrases = " + ".join(
        f"CAST(contains(lower(url), '{p}') OR contains(lower(html), '{p}') AS INTEGER)" for p in fixed.MULTI_PHRASES
    )
    serving = f"""
{similar_lists()},
{catalogue_records().strip()},
axes AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
ends AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM axes),
spots AS (
  SELECT vec_id, {rounded('2.0 * (x - x0) / (x1 - x0 + 1e-9) - 1.0', 4)} AS x, {rounded('2.0 * (y - y0) / (y1 - y0 + 1e-9) - 1.0', 4)} AS y
  FROM axes, ends),
serving AS (
  SELECT i::VARCHAR AS n, substring(url, 1, 200) AS d, t, p, v[-1] AS dl, coalesce(array_to_string(v[-26:], ','), '') AS tr,
         CASE WHEN coalesce(n, 0) < 6 OR a = 0 THEN 'new' WHEN b / a > 1.5 THEN 'growing' WHEN b / a < 0.5 THEN 'declining'
              ELSE 'stable' END AS tt,
         st, fk, i % 13 = 0 OR {phrases} >= 2 AS mh, pa, coalesce(si, '') AS si,
         'k' || (i % 11) || CASE WHEN i % 2 = 0 THEN '' ELSE ',plain' END
           || CASE WHEN i % 13 = 0 THEN ',{fixed.MULTI_KEYWORDS[0]}' ELSE ',other' END AS kw,
         replace(substring(html, 1, 200), chr(10), ' ') AS rm, '1.' || (i % 7) AS v, 1704067200 + 86400 * i * 2 AS dt,
         1704067200 + 86400 * i AS dc,
         CASE WHEN i % 4 <> 0 THEN 'git+https://github.com/o' || (i % 5) || '/r' || (i % 7) || '.git' ELSE '' END AS gh,
         coalesce(x, 0.0) AS x, coalesce(y, 0.0) AS y
  FROM recs LEFT JOIN lists ON src = i LEFT JOIN spots ON vec_id = i)"""
    out["q17b_serving"] = f"{serving} SELECT * FROM serving"
    # the brands come first: the page graph has a CTE named like their table
    out["q18b_published"] = f"""
WITH {BRANDS.strip()},
{serving.strip().removeprefix("WITH ")},
{NAMING.strip()},
{MENTIONS.strip()},
{origin_lines()},
counts AS (SELECT id, count(*) AS m FROM mentioned GROUP BY 1)
SELECT 'serving' AS dataset, n AS key, concat_ws('|', t, p, st) AS detail FROM serving
UNION ALL SELECT 'full', i::VARCHAR, concat_ws('|', st, CASE WHEN st IS NOT NULL THEN fk END, coalesce(si, '')) FROM recs LEFT JOIN lists ON src = i
UNION ALL SELECT 'edges', src || '|' || dst, CAST(round(score * 1000) AS BIGINT)::VARCHAR FROM edges
UNION ALL SELECT 'clusters', p_brand, members || '|' || pattern FROM shaped
UNION ALL SELECT 'cluster-words', cluster || '|' || rank, word FROM named
UNION ALL SELECT 'references', doc_id::VARCHAR, coalesce(m, 0)::VARCHAR
FROM documents JOIN lines ON lines.id = doc_id LEFT JOIN counts ON counts.id = doc_id WHERE origin_lines <> '' OR m > 0"""
    out["q18_full_nested"] = """
SELECT d.doc_id, d.lang, l.quality, CASE WHEN e.parent <> d.doc_id THEN e.parent END AS parent, d.text
FROM documents d LEFT JOIN labels l USING (doc_id)
JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS parent FROM documents) e USING (doc_id)"""
    out["q19_doc_freq"] = f"""
SELECT word, count(*) AS docs FROM (
  SELECT unnest(list_distinct(regexp_split_to_array(trim(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g')), ' +'))) AS word
  FROM documents)
WHERE length(word) > 3 AND word NOT IN ({words(fixed.FREQUENCY_STOP_WORDS)}) GROUP BY 1 HAVING count(*) >= 2"""
    out["q20_tfidf_terms"] = f"""
WITH {model('m', DOCS, tfidf.NEAR_DUPLICATES)} SELECT id, term, {rounded('w', 6)} AS weight FROM m_w"""
    out["q20b_uncapped_terms"] = f"""
WITH {model('m', DOCS, w.UNCAPPED)}
SELECT id, count(*) AS terms, {rounded('max(w)', 6)} AS heaviest, {rounded('sum(w)', 6)} AS total FROM m_w GROUP BY id"""
    out["q20c_without_common"] = f"""
WITH {model('m', DOCS, w.WITHOUT_COMMON)} SELECT id, term, {rounded('w', 6)} AS weight FROM m_w"""
    out["q21_near_dup"] = f"""
{near_duplicate_rows()}
SELECT id_a, id_b, {rounded('score', 3)} AS score, copies_a, copies_b, a.n_chars AS chars_a, b.n_chars AS chars_b
FROM pairs JOIN documents a ON a.doc_id = id_a JOIN documents b ON b.doc_id = id_b"""
    out["q21e_near_dup_published"] = f"""
{near_duplicates(fixed.NEAR_DUPLICATE_THRESHOLD)}
SELECT id_a, id_b, {rounded('score', 3)} AS score, copies_a, copies_b FROM pairs"""
    out["q21b_near_dup_top"] = f"""
{near_duplicate_rows()}
SELECT id_a, id_b, {rounded('score', 3)} AS score FROM (
  SELECT * FROM pairs ORDER BY score DESC, id_a, id_b LIMIT 20)"""
    out["q21c_copies"] = f"""
WITH {model('m', DOCS, tfidf.NEAR_DUPLICATES)},
sig AS (SELECT id, string_agg(term || ':' || tf, '|' ORDER BY term) AS s FROM m_w GROUP BY id)
SELECT id, rep FROM (SELECT id, min(id) OVER (PARTITION BY s) AS rep FROM sig) WHERE id <> rep"""
    out["q21d_pair_total"] = f"""
WITH {model('m', DOCS, tfidf.NEAR_DUPLICATES)}
SELECT count(*) AS pairs FROM (
  SELECT a.id, b.id FROM m_w a JOIN m_w b ON a.term = b.term AND a.id < b.id
  GROUP BY a.id, b.id HAVING {rounded('sum(a.w * b.w)', 8)} > {w.NEAR_DUPLICATE})"""
    out["q22_hybrid_topn"] = f"{page_graph()} SELECT src, dst, {rounded('score', 6)} AS score FROM edges"
    out["q23_two_hop"] = f"{page_graph()} SELECT src, dst, {rounded('score', 6)} AS score FROM hops"
    out["q24_similar"] = f"""
{page_graph()},
best AS (
  SELECT src, dst, least(max(score), 1.0) AS score FROM (
    SELECT src, dst, score FROM edges UNION ALL SELECT src, dst, score FROM hops) GROUP BY 1, 2)
SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS INTEGER) AS rank, {rounded('score', 3)} AS score
FROM best WHERE score > {fixed.NEIGHBOUR_THRESHOLD} QUALIFY rank <= {fixed.NEIGHBOURS}"""
    out["q25_assign"] = f"""
WITH axes AS (
  SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS axis FROM embeddings),
centres AS (SELECT label, axis, avg(x) AS c FROM axes GROUP BY 1, 2),
far AS (
  SELECT vec_id, c.label AS nearest, {rounded('sum((x - c) * (x - c))', 8)} AS distance
  FROM axes a JOIN centres c ON c.axis = a.axis GROUP BY 1, 2)
SELECT vec_id, nearest, {rounded('distance', 6)} AS distance FROM far
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) = 1"""
    out["q27_cohesion"] = f"""
WITH {COHESION.format(source='embeddings')} SELECT label, members, {rounded('cohesion', 8)} AS cohesion FROM tight"""
    out["q27b_cohesion_sample"] = f"""
WITH {COHESION.format(source=SAMPLED)} SELECT label, members, {rounded('cohesion', 8)} AS cohesion FROM tight"""
    out["q28_prune"] = f"""
WITH {COHESION.format(source='embeddings')},
kept AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS fresh FROM tight
  WHERE cohesion >= {w.PRUNE_AT})
SELECT vec_id, coalesce(fresh, -1) AS label FROM embeddings LEFT JOIN kept USING (label)"""
    out["q28b_named_clusters"] = f"""
WITH {COHESION.format(source='embeddings')},
kept AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS fresh FROM tight WHERE cohesion >= {w.PRUNE_AT}),
pruned AS (SELECT vec_id, coalesce(fresh, -1) AS label FROM embeddings LEFT JOIN kept USING (label)),
names AS (SELECT label, 'Vectors / ' || count(*) || ' / ' || min(vec_id) AS cluster_name FROM pruned WHERE label >= 0 GROUP BY 1)
SELECT vec_id, label, cluster_name FROM pruned LEFT JOIN names USING (label)"""
    out["q29_cluster_names"] = f"""
WITH {NAMING},
title AS (
  SELECT cluster, string_agg(upper(word[1]) || word[2:], ' / ' ORDER BY rank) AS t FROM named WHERE rank <= 3 GROUP BY 1),
largest AS (
  SELECT cluster, doc_id FROM (SELECT cluster, doc_id, n_chars, source || '/pi-' || doc_id AS name FROM naming)
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(n_chars, 0) DESC, name) = 1)
SELECT l.cluster, coalesce(t, CAST(doc_id AS VARCHAR)) AS cluster_name FROM largest l LEFT JOIN title USING (cluster)"""
    out["q29b_cluster_words"] = f"WITH {NAMING} SELECT cluster, word, docs, rank FROM named"
    out["q30_relative_words"] = f"""
WITH {model('m', DOCS, tfidf.CLUSTER_WORDS)},
sizes AS (SELECT lang AS cluster, count(*) AS members FROM documents GROUP BY 1),
overall AS (SELECT term, sum(w) / max(n) AS g FROM m_w, m_n GROUP BY 1),
inside AS (
  SELECT lang AS cluster, term, sum(w) AS s FROM m_w JOIN documents ON doc_id = id GROUP BY 1, 2),
scored AS (
  SELECT cluster, term,
         {rounded('CASE WHEN g > 1e-9 THEN (s / members) / (g + 1e-9) ELSE s / members * 100 END', 8)} AS ratio
  FROM inside JOIN sizes USING (cluster) JOIN overall USING (term)),
pool AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY ratio DESC, term) <= 300)
SELECT cluster, term AS word, {rounded('ratio', 3)} AS score FROM pool
WHERE ratio >= 1.2 AND NOT contains(term, ' ') AND length(term) > 3 AND term NOT IN ({words(fixed.CLUSTER_STOP_WORDS)})
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY ratio DESC, term) <= 80"""
    out["q31_cluster_meta"] = f"WITH {BRANDS} SELECT p_brand, members, total, ratio, pattern FROM shaped"
    out["q31b_largest_clusters"] = f"""
WITH {BRANDS} SELECT p_brand, members, total, ratio, pattern FROM shaped ORDER BY total DESC, p_brand LIMIT 10"""
    out["q32_drilldown"] = f"""
WITH {BRANDS},
best AS (SELECT p_brand, pattern, total FROM shaped WHERE pattern IN ('contested', 'blockbuster')
         ORDER BY total DESC, p_brand LIMIT 6)
SELECT p_brand, p_partkey, p_name, downloads, pattern, total,
       CAST(row_number() OVER (PARTITION BY p_brand ORDER BY downloads DESC NULLS LAST, p_partkey) AS INTEGER) AS rank
FROM members JOIN best USING (p_brand) QUALIFY rank <= 8"""
    out["q32b_top_terms"] = f"""
WITH {model('m', DOCS, tfidf.NEAR_DUPLICATES)},
sizes AS (SELECT lang AS cluster, count(*) AS members FROM documents GROUP BY 1),
mean AS (
  SELECT lang AS cluster, term, {rounded('sum(w) / max(members)', 8)} AS mean
  FROM m_w JOIN documents ON doc_id = id JOIN sizes ON sizes.cluster = lang GROUP BY 1, 2),
top AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, term) AS rank FROM mean QUALIFY rank <= 6)
SELECT cluster, 'C' || cluster || ': ' || max(term) FILTER (WHERE rank = 1) AS label,
       string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank <= 4) AS top_terms FROM top GROUP BY 1"""
    out["q34_mentions"] = f"WITH {MENTIONS} SELECT id, mentioned FROM mentioned"
    out["q34b_word_mentions"] = r"""
WITH tokens AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]{5,}')) AS name FROM conversations),
names AS (SELECT DISTINCT name FROM tokens),
ws AS (
  SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS name FROM documents)
SELECT id, name AS mentioned FROM ws JOIN names USING (name)"""
    out["q34c_sliced_mentions"] = r"""
WITH tokens AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]{5,}')) AS name FROM conversations),
names AS (SELECT DISTINCT name FROM tokens),
cut AS (
  SELECT page_id AS id, unnest(list_distinct(list_transform(range(1, length(url) - 3), lambda i: lower(substring(url, i, 5))))) AS gram
  FROM pages)
SELECT DISTINCT page_id AS id, name AS mentioned
FROM names JOIN cut ON gram = substring(name, 1, 5) JOIN pages ON page_id = id WHERE contains(lower(url), name)"""
    references = f"""
WITH {MENTIONS},
{origin_lines()},
counts AS (SELECT id, count(*) AS m FROM mentioned GROUP BY 1)
SELECT doc_id AS id, n_chars, coalesce(origin_lines, '') AS origin_lines, CAST(coalesce(m, 0) AS INTEGER) AS mentions
FROM documents JOIN lines ON lines.id = doc_id LEFT JOIN counts ON counts.id = doc_id
WHERE origin_lines <> '' OR m > 0"""
    out["q35_cross_refs"] = references
    out["q35b_largest_cross_refs"] = f"{references} ORDER BY coalesce(n_chars, 0) DESC, doc_id LIMIT 20"
    out["q36_copy_edges"] = """
SELECT doc_id AS child, parent FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS parent FROM documents)
WHERE doc_id <> parent"""
    out["q36b_fork_edges"] = """
SELECT s_name AS package, r_name AS forked_from, '' AS parent_url, n_nationkey AS stars, n_regionkey AS open_issues,
       '2024-01-01' AS pushed_at, 'owner/' || n_name AS repo
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey < 3"""
    out["q37_keyword_counts"] = r"""
SELECT keyword, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS keyword FROM documents)
WHERE starts_with(keyword, 'th') AND keyword <> 'the' GROUP BY 1 ORDER BY n DESC, keyword LIMIT 15"""
    out["q38_todo"] = """
SELECT doc_id, source, 'todo' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, NULL, 'stored' FROM labels"""
    out["q38b_vector_cache"] = "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width FROM embeddings"
    out["q38c_refreshed_store"] = f"""
WITH parts AS (
  SELECT user_id, ts, event_type, event_id, ts >= TIMESTAMP '{w.REFRESH_FROM}' AS later FROM events),
newest AS (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY user_id, later ORDER BY ts DESC, event_id DESC) = 1),
met AS (
  SELECT coalesce(a.user_id, b.user_id) AS user_id, b.ts IS NOT NULL AND (a.ts IS NULL OR b.ts >= a.ts + INTERVAL 7 DAY) AS due,
         a.event_type AS old_type, a.event_id AS old_id, b.event_type AS new_type, b.event_id AS new_id
  FROM (SELECT * FROM newest WHERE NOT later) a FULL JOIN (SELECT * FROM newest WHERE later) b ON a.user_id = b.user_id)
SELECT user_id, CASE WHEN due THEN new_type ELSE old_type END AS event_type, CASE WHEN due THEN new_id ELSE old_id END AS event_id
FROM met"""
    out["q38d_bucketed_cache"] = out["q38b_vector_cache"]
    out["q39_last_wins"] = """
SELECT c_name, o_orderkey, o_orderpriority AS priority FROM customer LEFT JOIN (
  SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
ON o_custkey = c_custkey"""
    out["q40_normalise"] = """
SELECT event_id, CASE WHEN event_type = 'click' THEN event_type ELSE json_extract_string(props, '$.k') END AS text,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""
    out["q40b_listing"] = """
SELECT c_name AS name, c_mktsegment AS description, CASE WHEN c_nationkey > 5 THEN 'a' || c_nationkey END AS author,
       CASE WHEN c_nationkey < 20 THEN c_mktsegment END AS publisher, c_mktsegment || ',x' AS keywords FROM customer"""
    out["q40c_registry"] = """
SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(p_size AS VARCHAR) AS latest_version, p_brand AS author,
       p_type AS video, CAST(2 AS INTEGER) AS versions_count FROM part"""
    out["q41_stream_weekly"] = f"""
SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, {rounded('sum(value)', 4)} AS total, count(*) AS n
FROM events
WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2"""
    out["q42_two_tier"] = """
SELECT c_custkey, c_acctbal, CASE WHEN coalesce(c_acctbal, 0) > 0 THEN 1 ELSE 2 END AS tier FROM customer"""
    out["q43_word_weights"] = f"""
WITH toks AS (
  SELECT lang, unnest(list_filter(regexp_extract_all(lower(regexp_replace(text, '[#*`\\[\\](){{}}|>]', ' ', 'g')),
         '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({words(tfidf.NEAR_DUPLICATES.stop_words)}))) AS word
  FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) >= 3)),
counted AS (SELECT lang, word, count(*) AS n FROM toks GROUP BY 1, 2),
top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rank FROM counted QUALIFY rank <= 120)
SELECT lang, word, n, rank, {rounded('n / max(n) OVER (PARTITION BY lang)', 6)} AS weight FROM top"""
    out["q43b_word_weights_all"] = f"""
WITH toks AS (
  SELECT unnest(list_filter(regexp_extract_all(lower(regexp_replace(text, '[#*`\\[\\](){{}}|>]', ' ', 'g')),
         '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({words(tfidf.NEAR_DUPLICATES.stop_words)}))) AS word FROM documents),
counted AS (SELECT word, count(*) AS n FROM toks GROUP BY 1),
top AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) AS rank FROM counted QUALIFY rank <= 120)
SELECT word, n, rank, {rounded('n / max(n) OVER ()', 6)} AS weight FROM top"""
    out["q44_scale"] = f"""
SELECT event_id, {rounded('2.0 * (value - lo) / (hi - lo + 1e-9) - 1.0', 8)} AS value
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)"""
    out["q45_landed_documents"] = """
SELECT CASE WHEN ok THEN s_suppkey::VARCHAR END AS name,
       CASE WHEN ok THEN s_name || ' body of ' || s_name ELSE ' ' END AS text,
       CASE WHEN ok THEN 'kw,' || s_nationkey END AS keywords,
       CASE WHEN ok THEN s_nationkey END::INTEGER AS versions_count, NOT ok AS corrupt
FROM (SELECT *, s_suppkey % 10 <> 0 AS ok FROM supplier)"""
    out["q45b_landed_arrays"] = """
SELECT 'seg ' || c_mktsegment AS name, max_by(c_name, c_custkey) AS description,
       DATE '1970-01-01' + max(c_custkey)::INTEGER AS date
FROM customer GROUP BY c_mktsegment"""
    out["q46_landed_downloads"] = """
WITH daily AS (
  SELECT l_suppkey, l_shipdate::DATE AS day, floor(sum(l_quantity))::BIGINT AS d FROM lineitem GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY day) AS rn FROM daily),
weekly AS (
  SELECT l_suppkey, (rn - 1) // 7 AS bucket, sum(d)::BIGINT AS downloads FROM placed GROUP BY 1, 2),
series AS (SELECT l_suppkey, list(downloads ORDER BY bucket) AS v FROM weekly GROUP BY 1)
SELECT s_suppkey::VARCHAR AS name, s_name, v[-1] AS downloads_last_week, coalesce(len(v), 0)::INTEGER AS weeks,
       coalesce(array_to_string(v[-4:], ','), '') AS last_weeks
FROM supplier LEFT JOIN series ON l_suppkey = s_suppkey"""
    return out
