"""One query for each corpus operator, with production parameters over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.llm.collocations import collocations
from docmill.llm.hilbert import nearest
from docmill.llm.licenses import license_scan
from docmill.llm.lines import line_dedup_digest
from docmill.llm.maxscore import maxscore_top_k
from docmill.llm.mixing import mix_sources
from docmill.llm.packing import harmonic_pack
from docmill.llm.pages import extract_main_text
from docmill.llm.ring import shard_rows
from docmill.llm.simhash import near_duplicates
from docmill.llm.substring import substring_dedup_digest
from docmill.llm.toxicity import toxicity
from docmill.llm.treap import ranked_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore_top_k(_table(spark, sf_dir, "embeddings")).drop("query_row")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings")).drop("query_row")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_digest(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(_table(spark, sf_dir, "documents"))


def op9_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op11_html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op12_k2_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_maxscore, op2_mix_sources, op3_harmonic_packing, op4_toxicity, op5_simhash_dedup, op6_hilbert_ann, op7_substring_dedup, op8_line_dedup, op9_bounded_ring, op10_license_scan, op11_html_lines, op12_k2_treap, op13_collocations, pipeline)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op1_maxscore": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.w, d.w) AS BIGINT) AS score FROM v q, v d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op2_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, 3 * source_size AS cap FROM t),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM p),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT arg_min(level, row(cap / weight, place)) AS level FROM l WHERE level * weight <= cap),
g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), m.level * weight) AS target FROM w, m),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mark, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(CAST(floor(target) AS BIGINT) - epochs * source_size - before, size)) AS BIGINT) AS taken FROM r""",
    "op7_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM s),
f AS (SELECT k, min(doc_id) AS first_doc FROM g GROUP BY k),
x AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS j FROM g JOIN f ON g.k = f.k WHERE g.doc_id > f.first_doc),
y AS (SELECT doc_id, list(j) AS gone FROM x GROUP BY doc_id),
z AS (SELECT doc_id, w, list_filter(w, lambda v, j: NOT coalesce(list_contains(gone, j), false)) AS kept FROM d LEFT JOIN y USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(w) - len(kept) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM z""",
    "op8_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
s AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS line FROM d),
k AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s),
h AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
x AS (SELECT k.*, h.key IS NOT NULL AS hit FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit), '')) AS kept_sha256 FROM x GROUP BY doc_id""",
    # the article of the tables' pages, which all mark it; the operator does not need such a mark
    "op11_html_lines": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
u AS (SELECT page_id, url, regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g') AS x FROM t),
v AS (SELECT page_id, url, trim(regexp_replace(x, '[ \t\n\r]+', ' ', 'g')) AS text FROM u)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM v""",
    "op12_k2_treap": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS j, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT j, item_id, t, count(*) AS times FROM b GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT k, doc_id, len(w) AS n, unnest(w) AS t FROM d),
f AS (SELECT k, doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM q) GROUP BY ALL),
g AS (SELECT t, count(*) AS df FROM f GROUP BY t),
x AS (SELECT f.*, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact FROM f JOIN g USING (t), s),
r AS (SELECT j, item_id, k, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN x USING (t) GROUP BY ALL HAVING sum(times * impact) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r) WHERE rank <= 20""",
    "op13_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS x FROM documents),
p AS (SELECT k, lang, unnest(x) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(m))),
f AS (SELECT lang, m, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, m, c AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
u AS (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT u.lang, u.phrase, a, k, x.c AS l, y.c AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(x.c AS HUGEINT) + y.c) AS BIGINT) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.head JOIN f y ON y.lang = u.lang AND y.phrase = u.tail),
b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT lang, a, array_to_string(w[j:j + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - n + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS n FROM c WHERE m > 2))),
o AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE around IS NULL OR CAST(100 AS HUGEINT) * around < CAST(80 AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT z.*, n, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM z JOIN t USING (lang)) WHERE rank <= 2000""",
}
