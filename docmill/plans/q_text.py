"""Queries of the text functions and report operators (P, O, U and W rows)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as X
from docmill.operators import report as R
from docmill.operators import rows as W
from docmill.operators import runs as U
from docmill.plans.registry import query

_S = "[ \\t\\n\\r\\f\\x0B]"


@query("p1_search_any", "SELECT p_partkey, p_name FROM part WHERE contains(lower(coalesce(p_name, '')), 'ring') OR contains(lower(coalesce(p_type, '')), 'ring') OR contains(lower(coalesce(p_brand, '')), 'ring')")
def _p1(t):
    return t("part").where(X.search_any(["p_name", "p_type", "p_brand"], "  RING ")).select("p_partkey", "p_name")


@query("p1_search_documents", "SELECT source, count(*) AS n FROM documents WHERE contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(lang, '')), 'license') GROUP BY source")
def _p1d(t):
    return t("documents").where(X.search_any(["text", "lang"], "License")).groupBy("source").agg(F.count("*").alias("n"))


@query("p2_numeric_filter", "SELECT count(*) FILTER (p_retailprice >= 1200) AS ge, count(*) FILTER (p_size < 10) AS lt, count(*) FILTER (p_size BETWEEN 10 AND 20) AS rng, count(*) FILTER (p_size = 7) AS eq, count(*) AS unread FROM part")
def _p2(t):
    hits = {"ge": ("p_retailprice", ">=1200"), "lt": ("p_size", "<10"), "rng": ("p_size", "10-20"), "eq": ("p_size", " 7 "), "unread": ("p_size", "many")}
    return t("part").agg(*[F.count_if(X.numeric_filter(c, f)).alias(n) for n, (c, f) in hits.items()])


@query("p2_numeric_filter_lineitem", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_returnflag")
def _p2l(t):
    return t("lineitem").where(X.numeric_filter("l_quantity", ">45")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("p3_facet_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'i') AND contains(lower(p_brand), '1') AND p_size BETWEEN 5 AND 25 AND p_retailprice > 950")
def _p3(t):
    return t("part").where(X.facet_filter({"p_name": "i", "p_brand": "1"}, {"p_size": "5-25", "p_retailprice": ">950"})).select("p_partkey")


_SOLID = f"regexp_replace(text, '{_S}', '', 'g')"


@query(
    "p4_is_garbled",
    f"SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN true WHEN length({_SOLID}) < 80 THEN false WHEN contains(text, chr(65533)) THEN true"
    + f" ELSE (length({_SOLID}) - length(regexp_replace({_SOLID}, '[\\p{{L}}\\p{{N}}.,;:!?()\\[\\]/%+\\-_=<>]', '', 'g'))) / length({_SOLID}) < 0.6 END AS garbled FROM documents",
)
def _p4(t):
    return t("documents").select("doc_id", X.is_garbled("text").alias("garbled"))


@query("p5_density_gate", "SELECT doc_id, length(coalesce(text, '')) / 500.0 < 2 AS scanned FROM documents")
def _p5(t):
    return t("documents").select("doc_id", X.density_gate("text", 50_000, 2).alias("scanned"))


@query("p6_clean_ws", f"SELECT doc_id, md5(regexp_replace(trim(regexp_replace(text, '{_S}+', ' ', 'g')), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g')) AS cleaned FROM documents")
def _p6(t):
    return t("documents").select("doc_id", F.md5(X.clean_ws("text")).alias("cleaned"))


_MD = r"""SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```[^`]*```', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'),
 '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^#{1,6}[ \t]+', '', 'g'), '[*_`]+', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS plain FROM conversations"""


@query("p7_markdown_to_text", _MD)
def _p7(t):
    return t("conversations").select("conv_id", "turn", "role", X.markdown_to_text("text").alias("plain"))


_HTML = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _e, _c in X.ENTITIES.items():
    _HTML = f"replace({_HTML}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
_HTML = f"trim(regexp_replace({_HTML}, '{_S}+', ' ', 'g'))"


@query("p8_html_to_text", f"SELECT page_id, md5({_HTML}) AS plain, length({_HTML}) AS chars FROM pages")
def _p8(t):
    plain = X.html_to_text("html")
    return t("pages").select("page_id", F.md5(plain).alias("plain"), F.length(plain).alias("chars"))


@query("p9_word_count", f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[#*_`>|\\[\\]()\\-]', ' ', 'g'), '{_S}+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents")
def _p9(t):
    return t("documents").select("doc_id", X.word_count("text").alias("words"))


_FIELDS = "list_filter([CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'lang' END, CASE WHEN quality IS NULL OR quality = 0 THEN 'quality' END, CASE WHEN toxic IS NULL OR toxic = 0 THEN 'toxic' END, CASE WHEN d.doc_id % 3 = 0 THEN 'title' END, CASE WHEN n_chars IS NULL OR n_chars = 0 THEN 'chars' END], lambda x: x IS NOT NULL)"


def _missing(t):
    fields = {"lang": F.col("lang"), "quality": F.col("quality"), "toxic": F.col("toxic"), "title": F.when(F.col("doc_id") % 3 != 0, F.col("source")), "chars": F.col("n_chars")}
    return t("documents").join(t("labels"), "doc_id", "left").withColumn("missing", R.missing_fields(fields))


@query("p10_missing_core_fields", f"SELECT d.doc_id, array_to_string({_FIELDS}, ',') AS missing, len({_FIELDS}) > 0 AS gaps FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _p10(t):
    return _missing(t).select("doc_id", F.array_join("missing", ",").alias("missing"), (F.size("missing") > 0).alias("gaps"))


@query(
    "p11_processing_status",
    f"WITH m AS (SELECT d.doc_id, {_FIELDS} AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, CASE WHEN len(missing) = 0 THEN 'Completed: core fields are available' WHEN len(missing) >= 4 THEN 'Partial extraction: missing ' || array_to_string(missing[1:5], ', ') ELSE 'Completed with gaps: ' || array_to_string(missing, ', ') END AS status FROM m",
)
def _p11(t):
    return _missing(t).select("doc_id", R.processing_status(F.col("missing")).alias("status"))


@query("p11_error_status", "SELECT doc_id, 'Failed: ' || source || ' - ' || CASE WHEN length(trim(text)) > 70 THEN rtrim(left(trim(text), 67)) || '...' ELSE trim(text) END AS status FROM documents")
def _p11e(t):
    return t("documents").select("doc_id", R.error_status(F.col("source"), F.col("text")).alias("status"))


_EVENT = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("note", T.StringType())])


def _payloads(t):
    k = F.get_json_object("props", "$.k")
    odd = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "zz": 1}'))).when(F.col("event_id") % 10 == 1, F.lit('{"k": "many", "note": "x"}')).otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "note": "  a  b "}')))
    return t("events").select("event_id", odd.alias("payload"))


_PAYLOADS = """WITH p AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'unknown: zz' WHEN event_id % 10 = 1 THEN 'type: k' END AS reason, json_extract_string(props, '$.k') AS k FROM events)"""


@query("p12_validate_rows", _PAYLOADS + " SELECT event_id, CAST(k AS INTEGER) AS k, 'a b' AS note FROM p WHERE reason IS NULL")
def _p12(t):
    return R.validate_rows(_payloads(t), "payload", _EVENT)[0]


@query("p12_quarantine", _PAYLOADS + " SELECT event_id, reason FROM p WHERE reason IS NOT NULL")
def _p12q(t):
    return R.validate_rows(_payloads(t), "payload", _EVENT)[1].drop("payload")


@query("p13_coalesce_aliases", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN nullif(trim(c_name), '') END, nullif(trim(c_mktsegment), '')) AS label FROM customer")
def _p13(t):
    rows = t("customer").withColumn("name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" "))
    return R.flat_report(rows, {"c_custkey": ["c_custkey"], "label": ["name", "c_mktsegment"]}).withColumn("c_custkey", F.col("c_custkey").cast("long"))


_NUM = "TRY_CAST(nullif(regexp_extract(text, '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE)"


@query("p14_coerce_number", f"SELECT doc_id, coalesce({_NUM}, 0.0) AS shown, CASE WHEN {_NUM} BETWEEN 0.1 AND 200 THEN {_NUM} END AS in_range FROM documents")
def _p14(t):
    return t("documents").select("doc_id", X.coerce_number("text").alias("shown"), X.coerce_number("text", 0.1, 200, None).alias("in_range"))


@query(
    "p15_make_label",
    """WITH p AS (SELECT p_partkey, 1990 + p_size AS y, p_retailprice / 100 AS v, p_type AS n, p_name || ': a/b?' AS title FROM part),
w AS (SELECT *, list_filter(regexp_split_to_array(n, ' +'), lambda x: x <> '') AS words, regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\\\|?*]', '', 'g'), '[ \\t\\n\\r]+', '_', 'g'), '^_+|_+$', '', 'g') AS clean FROM p),
s AS (SELECT *, CASE WHEN len(words) > 3 THEN upper(array_to_string(list_transform(words[1:4], lambda x: left(x, 1)), '')) ELSE left(array_to_string(words[1:3], ''), 20) END AS short FROM w)
SELECT p_partkey, '[' || y || '_IF' || CAST(CAST(round(v, 1) AS DECIMAL(20,1)) AS VARCHAR) || '_' || short || ']_' || left(clean, 100) AS label FROM s""",
)
def _p15(t):
    title = F.concat("p_name", F.lit(": a/b?"))
    return t("part").select("p_partkey", X.make_label(1990 + F.col("p_size"), F.col("p_retailprice") / 100, F.col("p_type"), title).alias("label"))


_HEAD = "left(text, 400)"
_LAST = f"greatest(CASE WHEN instr(reverse({_HEAD}), chr(10)) > 0 THEN length({_HEAD}) - instr(reverse({_HEAD}), chr(10)) ELSE -1 END, CASE WHEN instr(reverse({_HEAD}), ' .') > 0 THEN length({_HEAD}) - instr(reverse({_HEAD}), ' .') - 1 ELSE -1 END)"


@query("p16_truncate_at_boundary", f"SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN {_LAST} > 240 THEN left({_HEAD}, {_LAST} + 1) ELSE {_HEAD} END AS cut FROM documents")
def _p16(t):
    return t("documents").select("doc_id", X.truncate_at_boundary("text", 400, 0.6).alias("cut"))


@query("p17_prompt_table", "SELECT conv_id, turn, 'Extract from (' || role || '): ' || text || chr(10) || 'Examples: e1' || chr(10) || chr(10) || 'e2' AS prompt FROM conversations")
def _p17(t):
    rows = R.prompt_table(t("conversations"), "Extract from ({role}): {text}\nExamples: {examples}", {"role": F.col("role"), "text": F.col("text")}, ["e1", "e2", "e3"])
    return rows.select("conv_id", "turn", "prompt")


_ANSWERS = """a AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 6 AS i FROM events)"""


def _answers(t):
    p, i = F.col("props"), F.col("event_id") % 6
    fenced = F.concat(F.lit("Draft:\n```json\n{not json}\n```\nHere:\n```json\n"), p, F.lit("\n```\nDone"))
    two = F.concat(p, F.lit(" and "), p)
    return t("events").select("event_id", F.when(i == 0, p).when(i == 1, fenced).when(i == 2, F.concat(F.lit("I found "), p, F.lit(" in it"))).when(i == 3, "none").when(i == 4, two).otherwise(F.concat(p, F.lit(" }"))).alias("answer"))


@query("p18_parse_json_responses", f"WITH {_ANSWERS} SELECT event_id, CASE WHEN i < 3 THEN CAST(k AS INTEGER) END AS k FROM a")
def _p18(t):
    return _answers(t).select("event_id", F.get_json_object(R.parse_json_responses("answer"), "$.k").cast("int").alias("k"))


@query("p18_quarantine", f"WITH {_ANSWERS} SELECT event_id, i < 3 AS parsed FROM a")
def _p18q(t):
    parsed, refused = R.split_responses(_answers(t), "answer")
    return parsed.select("event_id", F.lit(True).alias("parsed")).unionByName(refused.select("event_id", F.lit(False).alias("parsed")))


@query(
    "p19_title_keys",
    "SELECT p_partkey, nullif(trim(regexp_replace(p_name || ' & Co.  ' || p_brand, '[ \\t]+', ' ', 'g')), '') AS exact, nullif(lower(trim(regexp_replace(replace(p_name || ' & Co.  ' || p_brand, '&', ' and '), '[^0-9A-Za-z]+', ' ', 'g'))), '') AS canonical,"
    " CASE WHEN p_partkey % 2 = 0 THEN left(lpad(CAST(p_partkey AS VARCHAR), 8, '1'), 4) || '-' || substr(lpad(CAST(p_partkey AS VARCHAR), 8, '1'), 5, 4) END AS issn FROM part",
)
def _p19(t):
    name = F.concat("p_name", F.lit(" & Co.  "), "p_brand")
    issn = F.concat(F.lit("ISSN "), F.lpad(F.col("p_partkey").cast("string"), 8, "1"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("99"))
    return t("part").select("p_partkey", X.exact_title(name).alias("exact"), X.canonical_title(name).alias("canonical"), X.normalize_issn(issn).alias("issn"))


@query("p20_fingerprint", "SELECT md5(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY md5(text)")
def _p20(t):
    return t("documents").groupBy(X.fingerprint("text").alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("p21_stable_id", "SELECT page_id, left(regexp_replace(regexp_replace(url, '[^0-9A-Za-z._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 27) || '-' || left(md5(url), 12) AS id FROM pages")
def _p21(t):
    return t("pages").select("page_id", X.stable_id("url", 40).alias("id"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"


@query("p22_host_in_suffix_list", f"SELECT page_id, ({_HOST} = 'org' OR ends_with({_HOST}, '.org')) OR ({_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com')) AS trusted FROM pages")
def _p22(t):
    return t("pages").select("page_id", X.host_in_suffix_list("url", ["org", "example.com"]).alias("trusted"))


@query("p23_relevance_score", f"SELECT page_id, CASE WHEN ends_with({_HOST}, '.org') OR {_HOST} = 'org' THEN 5 ELSE 0 END + CASE WHEN contains(lower(html), '<h1>') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(html, '(?i)privacy|cookie') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(html, '[0-9]{{4}}') THEN 3 ELSE 0 END AS score FROM pages")
def _p23(t):
    rules = [(X.host_in_suffix_list("url", ["org"]), 5), (F.lower("html").contains("<h1>"), 5), (F.col("html").rlike("(?i)privacy|cookie"), 4), (F.col("html").rlike("[0-9]{4}"), 3)]
    return t("pages").select("page_id", R.relevance_score(rules).alias("score"))


@query("o1_sort_report", "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS v FROM part ORDER BY coalesce(v, 0.0) DESC, p_partkey")
def _o1(t):
    return R.sort_report(t("part").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice")).alias("v")), "v", "p_partkey")


@query("o2_sort_table", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal END AS v FROM supplier ORDER BY v DESC NULLS FIRST, s_suppkey")
def _o2(t):
    return R.sort_table(t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 > 0, F.col("s_acctbal")).alias("v")), "v", True, "s_suppkey")


@query("u1_union_results_errors", "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value, CASE WHEN event_type = 'error' THEN props END AS message FROM events")
def _u1(t):
    e = t("events")
    return R.union_results_errors(e.where("event_type <> 'error'").select("event_id", "value"), e.where("event_type = 'error'").select("event_id", F.col("props").alias("message")))


@query("u3_ordered_distinct", "WITH f AS (SELECT conv_id, role, min(turn) AS pl FROM conversations GROUP BY conv_id, role) SELECT conv_id, string_agg(role, ',' ORDER BY pl) AS roles FROM f GROUP BY conv_id")
def _u3(t):
    return W.ordered_distinct(t("conversations"), ["conv_id"], "turn", "role").select("conv_id", F.array_join("values", ",").alias("roles"))


@query("u4_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")
def _u4(t):
    urgent = t("orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000")
    return W.difference(t("customer"), urgent, "c_custkey", "o_custkey").select("c_custkey")


@query("w1_keep_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def _w1(t):
    return W.keep_first(t("documents").select("doc_id", X.fingerprint("text").alias("fp")), [F.col("fp")], ["doc_id"]).select("doc_id")


@query("w2_top_n", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) <= 2")
def _w2(t):
    return W.top_n(t("lineitem"), ["l_orderkey"], 2, F.col("l_extendedprice").desc(), "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("w3_gaps_and_islands", "WITH f AS (SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, true) AS s FROM conversations), g AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f) SELECT conv_id, CAST(island AS BIGINT) AS island, min(role) AS role, count(*) AS turns FROM g GROUP BY conv_id, island")
def _w3(t):
    return W.islands(t("conversations"), ["conv_id"], ["turn"], "role").groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count("*").alias("turns"))


@query("w7_priority_pick", "SELECT l_partkey, l_suppkey AS source, l_extendedprice AS value FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, year(l_shipdate) DESC, l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def _w7(t):
    rows = t("lineitem").select("l_partkey", F.col("l_suppkey").alias("source"), F.col("l_extendedprice").alias("value"), F.year("l_shipdate").alias("year"), "l_orderkey", "l_linenumber")
    return W.priority_pick(rows, ["l_partkey"], [F.col("source"), -F.col("year"), -F.col("value"), F.col("l_orderkey"), F.col("l_linenumber")], ["source", "value"])


@query("w9_duplicate_suffix", "SELECT p_partkey, CASE WHEN n > 0 THEN p_name || '_' || n ELSE p_name END AS p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)")
def _w9(t):
    return R.duplicate_suffix(t("part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("s5_csv_cells", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[,\"\\n\\r]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS cell FROM conversations")
def _s5(t):
    return t("conversations").select("conv_id", "turn", R.csv_cell("text").alias("cell"))


@query("u2_union_distinct", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O'")
def _u2(t):
    rows = t("lineitem")
    return W.union_distinct(rows.where("l_returnflag = 'R'").select("l_orderkey"), rows.where("l_linestatus = 'O'").select("l_orderkey"))


_BY_USER = ["user_id"], ["ts", "event_id"]


@query("w4_neighbourhood", "SELECT event_id, max(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near_error FROM events")
def _w4(t):
    return W.near(t("events"), *_BY_USER, F.col("event_type") == "error", 2, 2, name="near_error").select("event_id", "near_error")


@query("w5_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error FROM events")
def _w5(t):
    return W.carry_forward(t("events"), *_BY_USER, F.when(F.col("event_type") == "error", F.col("event_id")), name="last_error").select("event_id", "last_error")


@query("w6_running_budget", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60")
def _w6(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    return U.running_budget(t("lineitem").select("l_orderkey", *order, "l_quantity"), ["l_orderkey"], order, F.col("l_quantity"), 60).select("l_orderkey", *order)


@query("w8_nearest_of_type", "SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events")
def _w8(t):
    return W.nearest_of_type(t("events"), *_BY_USER, F.when(F.col("event_type") == "error", F.col("event_id"))).select("event_id", "before", "after")