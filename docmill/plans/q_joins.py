"""Queries of joins, consensus, records and quality (J and A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions.text import fingerprint
from docmill.operators import consensus as C
from docmill.operators import quality as Q
from docmill.operators import records as K
from docmill.operators import resolve as R
from docmill.plans.registry import query


@query("j1_pending", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def _j1(t):
    docs = t("documents").select("doc_id", fingerprint("text").alias("fingerprint"))
    return R.pending(docs, docs.where("doc_id % 2 = 0")).select("doc_id")


@query("j2_cached", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def _j2(t):
    docs = t("documents").select("doc_id", fingerprint("text").alias("fingerprint"))
    return R.cached(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")).select("doc_id")


_DIM = """dim AS (SELECT n_nationkey, n_name AS title, lpad(CAST(10000000 + n_nationkey * 37 AS VARCHAR), 8, '0') AS issn FROM nation UNION ALL SELECT 100 + n_nationkey, lower(n_name), NULL FROM nation WHERE n_nationkey % 5 = 0),
ours AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN upper(n_name) || '  ' WHEN 2 THEN 'no such ' || n_name ELSE '-' || n_name || '-' END AS title, CASE WHEN c_custkey % 10 = 0 THEN lpad(CAST(10000000 + c_nationkey * 37 AS VARCHAR), 8, '0') END AS issn FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _keys_sql(table: str, id_: str) -> str:
    sq = "nullif(trim(regexp_replace(title, '[ \\t\\n\\r]+', ' ', 'g')), '')"
    return f"""SELECT {id_}, 0 AS prio, 'issn' AS kind, left(issn, 4) || '-' || substr(issn, 5) AS value FROM {table} WHERE issn IS NOT NULL UNION ALL SELECT {id_}, 2, 'exact_title', {sq} FROM {table} WHERE {sq} IS NOT NULL
 UNION ALL SELECT {id_}, 3, 'canonical_title', lower(trim(regexp_replace(title, '[^0-9A-Za-z]+', ' ', 'g'))) FROM {table} WHERE trim(regexp_replace(title, '[^0-9A-Za-z]+', ' ', 'g')) <> ''"""


_RESOLVED = f"""{_DIM}, dk AS ({_keys_sql('dim', 'n_nationkey')}), ok AS ({_keys_sql('ours', 'c_custkey')}),
h AS (SELECT c_custkey, ok.prio, ok.kind, count(DISTINCT n_nationkey) AS n, min(n_nationkey) AS matched FROM ok JOIN dk ON ok.kind = dk.kind AND ok.value = dk.value GROUP BY ALL),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY prio) = 1)"""


def _dim(t):
    n = t("nation")
    issn = F.lpad((10000000 + F.col("n_nationkey") * 37).cast("string"), 8, "0")
    return n.select("n_nationkey", F.col("n_name").alias("title"), issn.alias("issn")).unionByName(n.where("n_nationkey % 5 = 0").select((100 + F.col("n_nationkey")).alias("n_nationkey"), F.lower("n_name").alias("title"), F.lit(None).cast("string").alias("issn")))


def _ours(t):
    k = F.col("c_custkey")
    title = F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.upper("n_name"), F.lit("  "))).when(k % 4 == 2, F.concat(F.lit("no such "), "n_name")).otherwise(F.concat(F.lit("-"), "n_name", F.lit("-")))
    issn = F.when(k % 10 == 0, F.lpad((10000000 + F.col("c_nationkey") * 37).cast("string"), 8, "0"))
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", title.alias("title"), issn.alias("issn"))


@query("j3_resolve_entities", f"WITH {_RESOLVED} SELECT c_custkey, CASE WHEN kind IS NULL THEN 'NO_MATCH' WHEN n = 1 THEN 'OK' ELSE 'MULTI_MATCH' END AS status, kind AS method, matched, coalesce(n, 0) AS n_candidates FROM customer LEFT JOIN b USING (c_custkey)")
def _j3(t):
    ours, dim = _ours(t), _dim(t)
    keys = R.match_keys(ours, "c_custkey", F.col("title"), F.col("issn"))
    dims = R.match_keys(dim, "n_nationkey", F.col("title"), F.col("issn"))
    return R.resolve_entities(keys, dims, t("customer"), "c_custkey", "n_nationkey")


@query("j4_select_candidate", "SELECT s_suppkey, p_partkey, 'brand_selected' AS method FROM (SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey AS p_partkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY p_partkey % 40 <> s_suppkey % 40, p_partkey) = 1")
def _j4(t):
    pairs = t("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    pairs = pairs.select("s_suppkey", "p_partkey", F.concat(F.lit("Name & "), (F.col("s_suppkey") % 40).cast("string")).alias("ours"), F.concat(F.lit("name and "), (F.col("p_partkey") % 40).cast("string")).alias("title"), F.lit("brand").alias("method"))
    return R.select_candidate(pairs, "s_suppkey", "ours", "title", "p_partkey").select("s_suppkey", "p_partkey", "method")


@query("j5_lookup_curated", "WITH d AS (SELECT lower(p_brand) AS k, max(p_retailprice) AS best FROM part GROUP BY 1) SELECT p_partkey, best FROM part LEFT JOIN d ON lower(p_brand) = k AND p_partkey % 3 > 0")
def _j5(t):
    part = t("part")
    dim = part.groupBy("p_brand").agg(F.max("p_retailprice").alias("best")).withColumnRenamed("p_brand", "alias")
    shown = F.when(F.col("p_partkey") % 3 > 0, F.upper(F.regexp_replace("p_brand", "#", " # "))).otherwise("none")
    return R.lookup_curated(part.select("p_partkey", shown.alias("shown")), "shown", dim).select("p_partkey", "best")


_WORDS = ("econ", "STEEL", "polished", "brushed copper", "a")


@query("j6_lookup_contains", "WITH w AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in _WORDS) + "]) AS key, unnest([" + ", ".join(map(str, range(len(_WORDS)))) + "]) AS ordinal), n AS (SELECT DISTINCT p_type FROM part WHERE trim(p_type) <> ''), m AS (SELECT p_type, key, ordinal FROM n JOIN w ON contains(lower(p_type), lower(key)) OR contains(lower(key), lower(p_type)) QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY lower(p_type) <> lower(key), ordinal) = 1) SELECT p_partkey, part.p_type, key, ordinal FROM part LEFT JOIN m ON part.p_type = m.p_type")
def _j6(t):
    part = t("part")
    words = part.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}', {i})" for i, w in enumerate(_WORDS)) + " AS w(key, ordinal)")
    return R.lookup_contains(part, "p_partkey", "p_type", words)


def _observations(t):
    """Line items as observations of a part's quantity by suppliers."""
    return t("lineitem").select(F.col("l_partkey").alias("entity"), F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("source"), F.col("l_quantity").alias("value"), F.year("l_shipdate").alias("year"), "l_orderkey", "l_linenumber")


_OBS = "o AS (SELECT l_partkey AS entity, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS source, l_quantity AS value, CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey, l_linenumber FROM lineitem)"


@query("j7_agreement", f"WITH {_OBS}, g AS (SELECT *, count(*) AS copies FROM o GROUP BY ALL), x AS (SELECT a.entity, a.source, a.value, a.l_orderkey, a.l_linenumber, a.year, a.copies, sum(b.copies) AS n FROM g a JOIN g b ON a.entity = b.entity AND abs(a.value - b.value) <= 2 GROUP BY ALL) SELECT entity, l_orderkey, l_linenumber, source, value, CAST(n * copies AS BIGINT) AS agree FROM x")
def _j7(t):
    return C.agreement(_observations(t), 2.0).select("entity", "l_orderkey", "l_linenumber", "source", "value", "agree")


@query("j7_consensus", f"WITH {_OBS}, x AS (SELECT a.entity, a.source, a.value, a.l_orderkey, a.l_linenumber, count(*) AS agree FROM o a JOIN o b ON a.entity = b.entity AND abs(a.value - b.value) <= 0.6 GROUP BY ALL) SELECT entity, source, value FROM x WHERE agree >= 2 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY source, value, l_orderkey, l_linenumber) = 1")
def _j7c(t):
    return C.consensus(_observations(t), 0.6, "source", "value", "l_orderkey", "l_linenumber").select("entity", "source", "value")


def _ranked(t):
    """Observations with named sources, roles and a status, made of a line item's own numbers."""
    k = F.col("l_suppkey") % 6
    name = F.when(k == 0, "LETPUB").when(k == 1, "WOS").when(k == 2, "MJL").when(k == 3, "CURATED").when(k == 4, "CRAWLER").otherwise("BLOG")
    return t("lineitem").select(
        F.col("l_partkey").alias("entity"), name.alias("source"), F.col("l_quantity").alias("value"), F.year("l_shipdate").alias("year"),
        F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK").alias("status"), F.concat(F.lit("http://x/"), F.col("l_orderkey").cast("string")).alias("url"), F.when(k == 0, "primary").otherwise("secondary").alias("role"), "l_orderkey", "l_linenumber",
    )


_RANKED = """r AS (SELECT l_partkey AS entity, CASE l_suppkey % 6 WHEN 0 THEN 'LETPUB' WHEN 1 THEN 'WOS' WHEN 2 THEN 'MJL' WHEN 3 THEN 'CURATED' WHEN 4 THEN 'CRAWLER' ELSE 'BLOG' END AS source,
 CASE l_suppkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 9 END AS p, l_quantity AS value, CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN l_returnflag = 'R' THEN 'ERROR' ELSE 'OK' END AS status,
 'http://x/' || l_orderkey AS url, CASE WHEN l_suppkey % 6 = 0 THEN 'primary' ELSE 'secondary' END AS role, l_orderkey, l_linenumber FROM lineitem)"""


@query("a11_merge_sources", f"WITH {_RANKED}, f AS (SELECT entity, source, min(p) AS p FROM r GROUP BY entity, source), n AS (SELECT entity, string_agg(source, '+' ORDER BY p, source) AS sources FROM f GROUP BY entity), u AS (SELECT entity, url, year FROM r QUALIFY row_number() OVER (PARTITION BY entity ORDER BY p, source, l_orderkey, l_linenumber, url, year) = 1) SELECT entity, sources, url, year FROM n JOIN u USING (entity)")
def _a11(t):
    rows = _ranked(t).withColumn("p", C.source_priority(F.col("source"), _STRENGTH))
    return C.merge_sources(rows, "p", "source", "l_orderkey", "l_linenumber").select("entity", "sources", "url", "year")


_STRENGTH = {"WOS": 0, "MJL": 1, "CURATED": 2, "CRAWLER": 3, "LETPUB": 4}
_BY = "ORDER BY p, -coalesce(year, 0), -value, source, url"
_DECIDE = f"""WITH {_RANKED}, u AS (SELECT DISTINCT entity, role, source, value, year, url, p FROM r WHERE status = 'OK' AND value IS NOT NULL),
pri AS (SELECT * FROM u WHERE role = 'primary' QUALIFY row_number() OVER (PARTITION BY entity {_BY}) = 1),
sec AS (SELECT *, (SELECT count(*) FROM r WHERE r.status = 'OK' AND r.role = 'secondary' AND r.entity = u.entity AND abs(r.value - u.value) <= 0.6) AS n_any,
 p <= 2 AS strong, (SELECT count(*) FROM r WHERE r.status = 'OK' AND r.role = 'secondary' AND r.p <= 2 AND r.entity = u.entity AND abs(r.value - u.value) <= 0.6) AS n_auth FROM u WHERE role = 'secondary'),
an AS (SELECT * FROM sec WHERE n_any >= 2 QUALIFY row_number() OVER (PARTITION BY entity {_BY}) = 1),
au AS (SELECT * FROM sec WHERE strong AND n_auth >= 2 QUALIFY row_number() OVER (PARTITION BY entity {_BY}) = 1),
lone AS (SELECT * FROM sec QUALIFY row_number() OVER (PARTITION BY entity {_BY}) = 1),
near AS (SELECT DISTINCT sec.entity FROM sec JOIN pri ON sec.entity = pri.entity AND abs(sec.value - pri.value) <= 0.6),
st AS (SELECT entity, value, status FROM r QUALIFY row_number() OVER (PARTITION BY entity ORDER BY value IS NULL, status <> 'OK', p, -coalesce(year, 0), -value, source, url) = 1),
x AS (SELECT st.entity, st.value AS lv, st.status AS ls, CASE WHEN pri.entity IS NOT NULL AND near.entity IS NOT NULL THEN 1 WHEN pri.entity IS NOT NULL AND au.entity IS NOT NULL THEN 2 WHEN pri.entity IS NOT NULL AND an.entity IS NOT NULL THEN 3
 WHEN pri.entity IS NOT NULL THEN 4 WHEN an.entity IS NOT NULL THEN 5 ELSE 6 END AS rule, pri.value AS pv, au.value AS av, an.value AS nv, lone.value AS sv,
 row(pri.source, pri.value, pri.year, pri.url) AS pk, row(au.source, au.value, au.year, au.url) AS ak, row(an.source, an.value, an.year, an.url) AS nk, row(lone.source, lone.value, lone.year, lone.url) AS lk
 FROM st LEFT JOIN pri USING (entity) LEFT JOIN au USING (entity) LEFT JOIN an USING (entity) LEFT JOIN lone USING (entity) LEFT JOIN near USING (entity)),
y AS (SELECT entity, rule, lv, ls, sv, CASE WHEN rule IN (1, 4) THEN pv WHEN rule = 2 THEN av WHEN rule IN (3, 5) THEN nv ELSE sv END AS cv, CASE WHEN rule IN (1, 4) THEN pk WHEN rule = 2 THEN ak WHEN rule IN (3, 5) THEN nk ELSE lk END AS ck, pk FROM x),
m AS (SELECT y.entity, u.source, u.url, u.year, u.p, u.value, CASE WHEN row(u.source, u.value, u.year, u.url) = ck THEN 0 WHEN rule IN (1, 2, 3, 5) AND role = 'secondary' AND (rule <> 2 OR u.p <= 2) AND abs(u.value - cv) <= 0.6 THEN 1
 WHEN rule IN (2, 3) AND role = 'primary' AND row(u.source, u.value, u.year, u.url) = pk OR rule IN (4, 5) AND role = 'secondary' THEN 2 END AS place FROM u JOIN y USING (entity)),
o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY place, p, -coalesce(year, 0), -value, source, url) AS n FROM m WHERE place IS NOT NULL),
q AS (SELECT entity, string_agg(source, '+' ORDER BY n) AS sources FROM (SELECT entity, source, min(n) AS n FROM o GROUP BY entity, source) GROUP BY entity),
w AS (SELECT entity, arg_min(url, n) FILTER (url <> '') AS url, arg_min(year, n) FILTER (year <> 0) AS year FROM o GROUP BY entity)
SELECT entity, rule, coalesce(cv, lv) AS value, CASE WHEN rule = 1 THEN 'OK_VALIDATED' WHEN rule IN (2, 3) THEN 'OK_VALIDATED_SECONDARY' WHEN rule = 4 THEN CASE WHEN sv IS NULL THEN 'OK_PRIMARY_ONLY' ELSE 'OK_PRIMARY_UNCONFIRMED' END
 WHEN rule = 5 THEN 'OK_SECONDARY_VALIDATED' WHEN cv IS NOT NULL THEN 'OK' ELSE ls END AS status, sources, url, year FROM y LEFT JOIN q USING (entity) LEFT JOIN w USING (entity)"""


@query("a12_decide_value", _DECIDE)
def _a12(t):
    return C.decide_value(_ranked(t), priority=_STRENGTH)


@query("a13_weighted_pick", f"WITH {_RANKED}, s AS (SELECT *, (CASE source WHEN 'MJL' THEN 4 WHEN 'CRAWLER' THEN 3 WHEN 'CURATED' THEN 2 WHEN 'BLOG' THEN 1 ELSE 0 END) * 0.7::DOUBLE + year / 2024.0::DOUBLE * 0.3::DOUBLE AS score FROM r) SELECT entity, source, value, year, score FROM s QUALIFY row_number() OVER (PARTITION BY entity ORDER BY NOT value BETWEEN 0.1 AND 200, score DESC, value DESC, source) = 1")
def _a13(t):
    return C.weighted_pick(_ranked(t), {"MJL": 4, "CRAWLER": 3, "CURATED": 2, "BLOG": 1})


@query("a12_apply_decision", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 AND (v IS NULL OR v <= 0 OR v > 200 OR abs(v - w) >= 0.5) THEN w ELSE v END AS value, CASE WHEN o_orderkey % 5 < 3 AND NOT (o_orderkey % 7 = 0 AND o_orderkey % 5 > 0) THEN CASE WHEN o_orderkey % 5 = 0 THEN 'OK_VALIDATED' ELSE 'OK_PRIMARY_ONLY' END ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'OK_VALIDATED' ELSE 'NO_MATCH' END END AS status FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 1000 END AS v, o_totalprice / 1000 + (o_orderkey % 4) / 4.0 AS w FROM orders)")
def _a12b(t):
    k = F.col("o_orderkey")
    v, w = F.when(k % 3 > 0, F.col("o_totalprice") / 1000), F.col("o_totalprice") / 1000 + (k % 4) / 4.0
    status = F.when(k % 5 == 0, "OK_VALIDATED").when(k % 5 < 3, "OK_PRIMARY_ONLY").otherwise("NO_ACCESS")
    value, kept = C.apply_decision(v, w, status, F.when(k % 7 == 0, "OK_VALIDATED").otherwise("NO_MATCH"))
    return t("orders").select("o_orderkey", value.alias("value"), kept.alias("status"))


_LINES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q FROM lineitem"


@query(
    "j8_merge_records",
    """WITH e AS (SELECT DISTINCT l_orderkey, l_partkey AS pos, CAST(l_quantity AS BIGINT) AS sig, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 3 END AS score FROM lineitem WHERE l_linenumber <= 2), i AS (SELECT DISTINCT l_orderkey, l_partkey AS pos, CAST(l_quantity AS BIGINT) AS sig, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 3 END AS score FROM lineitem WHERE l_linenumber > 1),
g AS (SELECT l_orderkey, count(*) AS n, max(score) AS s FROM e GROUP BY 1), k AS (SELECT e.* FROM e JOIN g USING (l_orderkey) WHERE NOT (n = 1 AND s <= 1)), a AS (SELECT e.* FROM e JOIN g USING (l_orderkey) WHERE n = 1 AND s <= 1 AND l_orderkey NOT IN (SELECT l_orderkey FROM i)),
f AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.l_orderkey = i.l_orderkey AND k.sig = i.sig) QUALIFY row_number() OVER (PARTITION BY l_orderkey, sig ORDER BY pos) = 1),
z AS (SELECT *, 0 AS new FROM k UNION ALL SELECT *, 0 FROM a UNION ALL SELECT *, 1 FROM f) SELECT l_orderkey, count(*) AS n, CAST(sum(pos) AS BIGINT) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY new, pos, sig) AS rn FROM z) WHERE rn <= 6 GROUP BY 1""",
)
def _j8(t):
    rows = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("pos"), F.col("l_quantity").cast("long").alias("sig"), F.when(F.col("l_returnflag") == "R", 1).otherwise(3).alias("score"), "l_linenumber")
    old, new = (rows.where(c).drop("l_linenumber").distinct() for c in ("l_linenumber <= 2", "l_linenumber > 1"))
    return K.merge_records(old, new, "l_orderkey", "pos", "sig", "score").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("pos").alias("parts"))


@query(
    "j10_fill_nulls_by_position",
    """WITH r AS (SELECT l_orderkey, list({'q': CASE WHEN l_returnflag <> 'R' THEN l_quantity END, 'f': CASE WHEN l_linestatus = 'O' THEN l_linestatus END} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS a,
list({'q': l_quantity + 100, 'f': l_returnflag} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) FILTER (l_linenumber <= 2 OR l_orderkey % 2 = 0) AS b FROM lineitem GROUP BY 1),
z AS (SELECT l_orderkey, unnest(a) AS x, generate_subscripts(a, 1) AS i, b FROM r)
SELECT l_orderkey, CAST(i AS INTEGER) AS i, coalesce(x.q, CASE WHEN b IS NOT NULL THEN b[i].q END) AS q, coalesce(x.f, CASE WHEN b IS NOT NULL THEN b[i].f END) AS f FROM z""",
)
def _j10(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
    def listed(q, f, when):
        rows = F.array_sort(F.collect_list(F.when(when, F.struct(*order, q.alias("q"), f.alias("f")))))
        return F.transform(rows, lambda x: F.struct(x["q"].alias("q"), x["f"].alias("f")))
    q, flag, status = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    a = listed(F.when(flag != "R", q), F.when(status == "O", status), F.lit(True))
    b = listed(q + 100, flag, (F.col("l_linenumber") <= 2) | (F.col("l_orderkey") % 2 == 0))
    rows = t("lineitem").groupBy("l_orderkey").agg(a.alias("a"), b.alias("b")).withColumn("b", F.when(F.size("b") > 0, F.col("b")))
    filled = rows.select("l_orderkey", F.posexplode(K.fill_nulls_by_position("a", "b", ["q", "f"])).alias("i", "x"))
    return filled.select("l_orderkey", (F.col("i") + 1).alias("i"), "x.q", "x.f")


@query(
    "j9_apply_corrections",
    """WITH f AS (SELECT o_custkey AS c_custkey, o_orderpriority AS seg, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS bal, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT c_custkey, coalesce(CASE WHEN f.c_custkey IS NOT NULL AND seg <> '5-LOW' THEN seg END, c_mktsegment) AS c_mktsegment, coalesce(bal, c_acctbal) AS c_acctbal, f.c_custkey IS NOT NULL AS corrected, o_orderkey AS corrected_at, coalesce(n, 0) AS corrections FROM customer LEFT JOIN f USING (c_custkey)""",
)
def _j9(t):
    feedback = t("orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.col("o_orderpriority")).alias("c_mktsegment"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("c_acctbal"))
    return R.apply_corrections(t("customer"), feedback, "c_custkey", "o_orderkey", ["c_mktsegment"], ["c_acctbal"]).select("c_custkey", "c_mktsegment", "c_acctbal", "corrected", "corrected_at", "corrections")


@query("j11_backfill", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, url) AS lang, CASE WHEN page_id * 10 BETWEEN 1900 AND 2100 THEN CAST(page_id * 10 AS INTEGER) END AS year FROM documents LEFT JOIN pages ON doc_id = page_id")
def _j11(t):
    docs = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" ").alias("lang"), F.lit(None).cast("int").alias("year"))
    pages = t("pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("lang"), (F.col("page_id") * 10).alias("year"))
    return R.backfill(docs, pages, "doc_id", ["lang"], ["year"])


_LABELLED = "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query("a1_field_completeness", f"WITH x AS (SELECT lang, quality, toxic {_LABELLED}) SELECT 'lang' AS field, count(*) FILTER (coalesce(trim(lang), '') <> '') AS present, count(*) FILTER (coalesce(trim(lang), '') = '') AS missing FROM x UNION ALL SELECT 'quality', count(quality), count(*) - count(quality) FROM x UNION ALL SELECT 'toxic', count(toxic), count(*) - count(toxic) FROM x")
def _a1(t):
    return Q.field_completeness(t("documents").join(t("labels"), "doc_id", "left"), ["lang", "quality", "toxic"])


_BOILER = ("license", "rights", "http", "the and")


@query("a2_noisy_ratio", "SELECT count(*) AS records, count(*) FILTER (" + " OR ".join(f"contains(lower(text), '{w}')" for w in _BOILER) + ") AS noisy, round(count(*) FILTER (" + " OR ".join(f"contains(lower(text), '{w}')" for w in _BOILER) + ") * 100.0::DOUBLE / count(*), 1) AS percent FROM documents")
def _a2(t):
    return Q.noisy_ratio(t("documents"), "text", _BOILER)


@query("a2_noisy_examples", "SELECT doc_id, text FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in _BOILER) + " ORDER BY doc_id LIMIT 5")
def _a2e(t):
    return Q.noisy_examples(t("documents"), "doc_id", "text", _BOILER)


@query("a12_provenance", """WITH x AS (SELECT o_orderkey AS k, o_custkey % 5 AS a, o_custkey % 3 AS b FROM orders) SELECT k, CASE WHEN k % 4 = 0 THEN 'LETPUB+WOS' WHEN a = b THEN CASE WHEN k % 2 = 1 THEN 'LETPUB+MJL' ELSE 'LETPUB+WOS+MJL' END ELSE CASE WHEN k % 2 = 1 THEN 'LETPUB+MJL' ELSE 'WOS+MJL' END END AS sources,
CASE WHEN k % 3 = 0 THEN 'old' ELSE 'new' || k END AS url, CASE WHEN k % 4 = 0 THEN 2020 ELSE 2023 END AS year FROM (SELECT *, k % 2 FROM x)""")
def _a12p(t):
    k, a, b = F.col("o_orderkey"), F.col("o_custkey") % 5, F.col("o_custkey") % 3
    found = F.when(k % 2 == 1, "LETPUB+MJL").otherwise("WOS+MJL"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("new"), k.cast("string"))), F.lit(2023)
    sources, url, year = C.apply_provenance(a.cast("double"), b.cast("double"), F.when(k % 4 == 0, "NO_MATCH").otherwise("OK_VALIDATED"), (F.when((k % 4 != 0) & (k % 2 == 1), "LETPUB").otherwise("LETPUB+WOS"), F.lit("old"), F.lit(2020)), found)
    return t("orders").select(k.alias("k"), sources.alias("sources"), url.alias("url"), year.alias("year"))


@query("a7_collapse_records", "SELECT l_orderkey, string_agg('[' || l_partkey || '] ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS l_returnflag, coalesce(string_agg(CASE WHEN l_linestatus = 'O' THEN '[' || l_partkey || '] ' || l_linestatus END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS open FROM lineitem GROUP BY 1")
def _a7(t):
    rows = t("lineitem").withColumn("open", F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")))
    return K.collapse_records(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", ["l_returnflag", "open"])


@query("a8_best_record", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END DESC NULLS LAST, l_linenumber, l_partkey, l_suppkey) = 1")
def _a8(t):
    value = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    return K.best_record(t("lineitem"), "l_orderkey", value, "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _complete(t):
    rows = t("part").withColumn("grp", F.col("p_partkey") % 50)
    k = F.col("p_partkey")
    return K.record_completeness(rows, {"name": F.when(k % 3 > 0, F.col("p_name")), "brand": F.when(k % 4 > 0, F.col("p_brand")), "type": F.when(k % 7 > 0, F.col("p_type"))}, {"size": F.when(k % 5 > 0, F.col("p_size")), "price": F.col("p_retailprice")})


_COMPLETE = """c AS (SELECT p_partkey, p_partkey % 50 AS grp, list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'name' END, CASE WHEN p_partkey % 4 = 0 THEN 'brand' END, CASE WHEN p_partkey % 7 = 0 THEN 'type' END], lambda x: x IS NOT NULL) AS mc, list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'size' END], lambda x: x IS NOT NULL) AS mi FROM part)"""


@query("a9_record_completeness", f"WITH {_COMPLETE} SELECT p_partkey, array_to_string(mc, ',') AS missing_critical, array_to_string(mi, ',') AS missing_important, (5 - len(mc) - len(mi)) / 5.0::DOUBLE AS completeness FROM c")
def _a9(t):
    return _complete(t).select("p_partkey", F.array_join("missing_critical", ",").alias("missing_critical"), F.array_join("missing_important", ",").alias("missing_important"), "completeness")


@query("a9_document_completeness", f"WITH {_COMPLETE}, u AS (SELECT DISTINCT grp, unnest(mc) AS f FROM c), s AS (SELECT grp, string_agg(f, ',' ORDER BY f) AS missing FROM u GROUP BY 1), g AS (SELECT grp, count(*) AS records, round(avg((5 - len(mc) - len(mi)) / 5.0::DOUBLE), 6) AS completeness FROM c GROUP BY 1) SELECT grp, records, coalesce(missing, '') AS missing, completeness, missing IS NULL AS is_complete, missing IS NOT NULL AS needs_follow_up FROM g LEFT JOIN s USING (grp)")
def _a9d(t):
    return K.document_completeness(_complete(t), "grp").withColumns({"missing": F.array_join("missing", ","), "completeness": F.round("completeness", 6)})


@query("a10_abnormal_count", "SELECT c_custkey, CAST(c_custkey % 3 = 0 AS INT) + CAST(c_nationkey = 0 AS INT) + CAST(c_custkey % 2 = 0 AS INT) + CAST(c_custkey % 5 = 0 AS INT) AS abnormal, CAST(c_custkey % 3 = 0 AS INT) + CAST(c_nationkey = 0 AS INT) + CAST(c_custkey % 2 = 0 AS INT) + CAST(c_custkey % 5 = 0 AS INT) > 3 AS flagged FROM customer")
def _a10(t):
    k = F.col("c_custkey")
    rows = t("customer").select("c_custkey", F.when(k % 3 > 0, F.col("c_name")).alias("n"), "c_nationkey", F.when(k % 2 == 0, F.lit(0.0)).otherwise(1.0).alias("b"), F.when(k % 5 == 0, F.lit("  ")).otherwise("x").alias("s"))
    n = K.abnormal_count(["n", "c_nationkey", "b", "s"])
    return rows.select("c_custkey", n.alias("abnormal"), (n > 3).alias("flagged"))


@query("a15_field_accuracy", "WITH p AS (SELECT d.doc_id, CASE WHEN regexp_matches(text, '!!|###') THEN 0 ELSE 1 END AS quality, CASE WHEN contains(lower(text), 'idiot') THEN 1 ELSE 0 END AS toxic FROM documents d), j AS (SELECT p.quality = l.quality AS a, p.toxic = l.toxic AS b FROM p JOIN labels l USING (doc_id)) SELECT 'quality' AS field, count(*) AS compared, round(avg(CAST(a AS DOUBLE)) * 100, 2) AS percent FROM j UNION ALL SELECT 'toxic', count(*), round(avg(CAST(b AS DOUBLE)) * 100, 2) FROM j")
def _a15(t):
    pred = t("documents").select("doc_id", F.when(F.col("text").rlike("!!|###"), 0).otherwise(1).alias("quality"), F.when(F.lower("text").contains("idiot"), 1).otherwise(0).alias("toxic"))
    return Q.field_accuracy(pred, t("labels"), "doc_id", ["quality", "toxic"])
