"""Merges, sorting, dictionaries, parsing, sampling and file round trips over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import shared_dir, with_position
from ..operators import relational as R
from ..operators.sampling import bootstrap_rows, sample_rows
from ..sources.delimited import read_delimited, write_delimited
from ..sources.xlsx import read_xlsx, write_xlsx
from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Whole tables; the keys of some rows are altered so that either side has rows that the other lacks.
_LINE_KEY = "CASE WHEN l_orderkey % 7 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END"
_ORDER_KEY = "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1000000000000 ELSE o_orderkey END"


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.expr(_LINE_KEY).alias("k"), F.col("l_extendedprice").alias("price"))


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.expr(_ORDER_KEY).alias("k"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"))


_LINES = f"SELECT {_LINE_KEY} AS k, l_extendedprice AS price FROM lineitem"
_ORDERS = f"SELECT {_ORDER_KEY} AS k, o_orderpriority AS priority, o_totalprice AS total FROM orders"
_FULL = f"""
    FROM (SELECT *, 1 AS m FROM ({_LINES})) a FULL JOIN (SELECT *, 1 AS u FROM ({_ORDERS})) b ON a.k = b.k
"""
_CLASS = "CASE WHEN m IS NULL THEN 2 WHEN u IS NULL THEN 1 ELSE 3 END"


@query(f"""
    SELECT priority, {_CLASS} AS merge_class, count(*) AS n, round(sum(price), 2) AS price {_FULL} GROUP BY 1, 2
""")
def merge_flagship(spark, d):
    out = R.keyed_merge(_lines(spark, d), _orders(spark, d), ["k"], "m:1")
    return out.groupBy("priority", F.col("_merge").alias("merge_class")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query(f"SELECT coalesce(a.k, b.k) AS k, price, priority, total, {_CLASS} AS _merge {_FULL}")
def merge_m_1(spark, d):
    return R.keyed_merge(_lines(spark, d), _orders(spark, d), ["k"], "m:1")


@query(f"""
    SELECT coalesce(a.k, b.k) AS k, priority, total, price, CASE WHEN m IS NULL THEN 1 WHEN u IS NULL THEN 2 ELSE 3 END AS _merge {_FULL}
""")
def merge_1_m(spark, d):
    return R.keyed_merge(_orders(spark, d), _lines(spark, d), ["k"], "1:m")


@query("""
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, quality, toxic,
           CASE WHEN d.doc_id IS NULL THEN 2 WHEN l.doc_id IS NULL THEN 1 ELSE 3 END AS _merge
    FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, lang FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id
""")
def merge_1_1(spark, d):
    docs = table(spark, d, "documents").select(F.expr("CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END").alias("doc_id"), "lang")
    return R.keyed_merge(docs, table(spark, d, "labels").select("doc_id", "quality", "toxic"), ["doc_id"], "1:1")


@query("""
    WITH a AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
         b AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS j, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT coalesce(a.k, b.k) AS k, o_orderkey, event_id, CASE WHEN a.k IS NULL THEN 2 WHEN b.k IS NULL THEN 1 ELSE 3 END AS _merge
    FROM a FULL JOIN b ON a.k = b.k
    WHERE a.k IS NULL OR b.k IS NULL OR i = j OR (i = a.n AND j > a.n) OR (j = b.n AND i > b.n)
""")
def merge_m_m(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    b = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_id")
    return R.keyed_merge(a, b, ["k"], "m:m", master_order=["o_orderkey"], using_order=["event_id"])


@query("""
    WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer),
         b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part)
    SELECT c_custkey, p_partkey, CASE WHEN a.r IS NULL THEN 2 WHEN b.r IS NULL THEN 1 ELSE 3 END AS _merge FROM a FULL JOIN b ON a.r = b.r
""")
def merge_position(spark, d):
    return R.positional_merge(table(spark, d, "customer").select("c_custkey"), table(spark, d, "part").select("p_partkey"), ["c_custkey"], ["p_partkey"])


_NULL_A = "SELECT CASE WHEN c_custkey % 500 = 0 THEN NULL ELSE c_nationkey END AS k, c_mktsegment AS seg, c_custkey FROM customer"
_NULL_B = "SELECT CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey END AS k, min(s_acctbal) AS bal FROM supplier GROUP BY 1"


@query(f"""
    SELECT coalesce(a.k, b.k) AS k, seg, c_custkey, bal, CASE WHEN m IS NULL THEN 2 WHEN u IS NULL THEN 1 ELSE 3 END AS _merge
    FROM (SELECT *, 1 AS m FROM ({_NULL_A})) a FULL JOIN (SELECT *, 1 AS u FROM ({_NULL_B})) b ON a.k IS NOT DISTINCT FROM b.k
""")
def merge_null_keys(spark, d):
    a = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 500 == 0, None).otherwise(F.col("c_nationkey")).alias("k"), F.col("c_mktsegment").alias("seg"), "c_custkey")
    b = table(spark, d, "supplier").groupBy(F.when(F.col("s_nationkey") == 3, None).otherwise(F.col("s_nationkey")).alias("k")).agg(F.min("s_acctbal").alias("bal"))
    return R.keyed_merge(a, b, ["k"], "m:1")


def _keep(classes: set[int], where: str):
    def run(spark, d):
        return R.keyed_merge(_lines(spark, d), _orders(spark, d), ["k"], "m:1", keep=classes)

    run.__name__ = "merge_keep_" + "_".join(map(str, sorted(classes)))
    query(f"SELECT * FROM (SELECT coalesce(a.k, b.k) AS k, price, priority, total, {_CLASS} AS _merge {_FULL}) WHERE _merge IN ({where})")(run)


for _c, _w in (({3}, "3"), ({1, 3}, "1, 3"), ({2, 3}, "2, 3"), ({1}, "1"), ({2}, "2"), ({1, 2}, "1, 2")):
    _keep(_c, _w)

_MASTER_KEY = "CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END"
_SHARED_A = f"SELECT {_MASTER_KEY} AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders"
_SHARED_B = f"SELECT {_ORDER_KEY} AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE -o_totalprice END AS v FROM orders"


def _shared(value: str, **options):
    def run(spark, d):
        o = table(spark, d, "orders")
        k = F.col("o_orderkey")
        a = o.select(F.expr(_MASTER_KEY).alias("k"), F.when(k % 3 == 0, None).otherwise(F.col("o_totalprice")).alias("v"))
        b = o.select(F.expr(_ORDER_KEY).alias("k"), F.when(k % 4 == 0, None).otherwise(-F.col("o_totalprice")).alias("v"))
        return R.keyed_merge(a, b, ["k"], "1:1", **options)

    run.__name__ = "merge_" + ("_".join(sorted(options)) or "master_wins")
    query(f"""
        SELECT coalesce(a.k, b.k) AS k, CASE WHEN m IS NULL THEN b.v WHEN u IS NULL THEN a.v ELSE {value} END AS v,
               {_CLASS} AS _merge
        FROM (SELECT *, 1 AS m FROM ({_SHARED_A})) a FULL JOIN (SELECT *, 1 AS u FROM ({_SHARED_B})) b ON a.k = b.k
    """)(run)


_shared("a.v")
_shared("coalesce(a.v, b.v)", update=True)
_shared("coalesce(b.v, a.v)", replace=True)
_shared("b.v", replace=True, replace_missing=True)


@query(f"SELECT coalesce(a.k, b.k) AS k, price, total {_FULL}")
def merge_keepusing_nogenerate(spark, d):
    return R.keyed_merge(_lines(spark, d), _orders(spark, d), ["k"], "m:1", keepusing=["total"], generate=None)


@query(f"SELECT {_CLASS} AS _merge, count(*) AS n {_FULL} GROUP BY 1")
def merge_counts(spark, d):
    return R.merge_counts(R.keyed_merge(_lines(spark, d), _orders(spark, d), ["k"], "m:1"))


@query("""
    SELECT k, c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN 1 ELSE 3 END AS _merge FROM (
      SELECT c_custkey AS k, c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS o_orderkey FROM customer)
""")
def merge_unchecked_first(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_custkey")
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return R.keyed_merge(a, b, ["k"], "m:1", unchecked=True, using_order=["o_orderkey"], keep={1, 3})


@query("""
    SELECT o_orderkey, o_orderpriority, v, row_number() OVER (ORDER BY o_orderpriority NULLS LAST, v NULLS LAST, o_orderkey) AS position
    FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)
""")
def sort_multi_key(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_totalprice")).alias("v"))
    return with_position(R.sort_rows(o, ["o_orderpriority", "v"], ["o_orderkey"]), "position", ["o_orderpriority", "v", "o_orderkey"])


@query("SELECT doc_id, lang, source, row_number() OVER (ORDER BY lang NULLS LAST, source NULLS LAST, doc_id) AS position FROM documents")
def sort_strings(spark, d):
    return with_position(table(spark, d, "documents").select("doc_id", "lang", "source"), "position", ["lang", "source", "doc_id"])


_SEG = "CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 51 = 0 THEN NULL ELSE c_mktsegment END"


def _segments(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k, F.when(k % 50 == 0, "").when(k % 51 == 0, None).otherwise(F.col("c_mktsegment")).alias("seg"))


@query(f"""
    WITH c AS (SELECT c_custkey, {_SEG} AS seg FROM customer),
         l AS (SELECT seg, row_number() OVER (ORDER BY seg) AS code FROM (SELECT DISTINCT seg FROM c WHERE seg <> ''))
    SELECT c_custkey, c.seg, CAST(code AS INTEGER) AS code FROM c LEFT JOIN l USING (seg)
""")
def encode_labels(spark, d):
    return R.encode_labels(_segments(spark, d), ["seg"], ["code"])[0]


@query(f"SELECT CAST(row_number() OVER (ORDER BY seg) AS INTEGER) AS code, seg AS label FROM (SELECT DISTINCT {_SEG} AS seg FROM customer) WHERE seg <> ''")
def encode_dictionary(spark, d):
    return R.encode_labels(_segments(spark, d), ["seg"], ["code"])[1]


def _known(spark) -> DataFrame:
    return spark.createDataFrame([(10, "FURNITURE"), (20, "MACHINERY")], "code int, label string")


@query(f"SELECT c_custkey, seg, CASE seg WHEN 'FURNITURE' THEN 10 WHEN 'MACHINERY' THEN 20 END AS code FROM (SELECT c_custkey, {_SEG} AS seg FROM customer)")
def encode_noextend(spark, d):
    return R.encode_labels(_segments(spark, d), ["seg"], ["code"], labels=_known(spark), noextend=True)[0]


@query(f"""
    WITH c AS (SELECT DISTINCT {_SEG} AS seg FROM customer)
    SELECT 10 AS code, 'FURNITURE' AS label UNION ALL SELECT 20, 'MACHINERY' UNION ALL
    SELECT CAST(20 + row_number() OVER (ORDER BY seg) AS INTEGER), seg FROM c WHERE seg <> '' AND seg NOT IN ('FURNITURE', 'MACHINERY')
""")
def encode_extend(spark, d):
    return R.encode_labels(_segments(spark, d), ["seg"], ["code"], labels=_known(spark), extend=True)[1]


@query("""
    WITH v AS (SELECT DISTINCT x FROM (SELECT l_returnflag AS x FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem)),
         l AS (SELECT x, CAST(row_number() OVER (ORDER BY x) AS INTEGER) AS code FROM v)
    SELECT a.code AS flag_code, b.code AS status_code, count(*) AS n FROM lineitem JOIN l a ON l_returnflag = a.x JOIN l b ON l_linestatus = b.x GROUP BY 1, 2
""")
def encode_two_columns(spark, d):
    out, _ = R.encode_labels(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"], ["flag_code", "status_code"])
    return out.groupBy("flag_code", "status_code").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_regionkey, coalesce(CASE WHEN r_regionkey < 4 THEN r_name END, '') AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def decode_labels(spark, d):
    labels = table(spark, d, "region").filter("r_regionkey < 4").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"))
    return R.decode_labels(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), ["n_regionkey"], labels, ["label"])


@query("SELECT n_nationkey, n_regionkey, substring(coalesce(r_name, ''), 1, 3) AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def decode_maxlength(spark, d):
    labels = table(spark, d, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"))
    return R.decode_labels(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), ["n_regionkey"], labels, ["label"], maxlength=3)


@query("SELECT CAST(max(length(n_name)) AS INTEGER) AS longest FROM nation")
def label_longest(spark, d):
    return R.longest_label(table(spark, d, "nation").select(F.col("n_name").alias("label")))


@query("SELECT p_partkey, CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand FROM part")
def parse_ignore(spark, d):
    return R.parse_numeric(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"], ["brand"], ignore="Brand#").select("p_partkey", "brand")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 100, 0) / 100 AS rate FROM lineitem")
def parse_percent(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" %")).alias("t"))
    return R.parse_numeric(rows, ["t"], ["rate"], percent=True, ignore=" ").select("l_orderkey", "l_linenumber", "l_partkey", "rate")


@query("SELECT o_orderkey, o_totalprice AS price FROM orders")
def parse_decimal_comma(spark, d):
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return R.parse_numeric(rows, ["t"], ["price"], dpcomma=True).select("o_orderkey", "price")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events")
def parse_force(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select(e, F.when(e % 3 == 0, "n.a.").when(e % 5 == 0, "NA").otherwise(F.concat(F.lit("  "), F.col("value").cast("string"), F.lit(" "))).alias("t"))
    return R.parse_numeric(rows, ["t"], ["v"], force=True).select("event_id", "v")


@query("SELECT count(*) FILTER (WHERE event_id % 3 <> 0 AND event_id % 5 <> 0) AS n_converted, count(*) FILTER (WHERE event_id % 3 = 0) AS n_failed FROM events")
def parse_counts(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select(F.when(e % 3 == 0, "n.a.").when(e % 5 == 0, ".").otherwise(F.col("value").cast("string")).alias("t"))
    return R.parse_counts(rows, "t")


# -------------------------------------------------------------------------------------- sampling


@query("SELECT o_orderpriority, CAST(floor(0.3 * count(*) + 0.5) AS BIGINT) AS n, CAST(floor(0.3 * count(*) + 0.5) AS BIGINT) AS n_distinct FROM orders GROUP BY 1")
def sample_percent_by(spark, d):
    s = sample_rows(table(spark, d, "orders"), ["o_orderkey"], percent=30, by=["o_orderpriority"], seed=3)
    return s.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_distinct"))


@query("SELECT CAST(least(500, count(*)) AS BIGINT) AS n FROM orders")
def sample_count(spark, d):
    return sample_rows(table(spark, d, "orders"), ["o_orderkey"], count=500).agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) FILTER (WHERE o_orderstatus <> 'O') AS BIGINT) AS outside, CAST(floor(0.25 * count(*) FILTER (WHERE o_orderstatus = 'O') + 0.5) AS BIGINT) AS inside FROM orders")
def sample_where(spark, d):
    s = sample_rows(table(spark, d, "orders"), ["o_orderkey"], percent=25, where=F.col("o_orderstatus") == "O")
    is_o = F.col("o_orderstatus") == "O"
    return s.agg(F.count(F.when(~is_o, 1)).alias("outside"), F.count(F.when(is_o, 1)).alias("inside"))


@query("SELECT o_orderpriority, count(*) AS n_rows, CAST(count(*) AS BIGINT) AS n_drawn FROM orders GROUP BY 1")
def bootstrap_strata_weight(spark, d):
    b = bootstrap_rows(table(spark, d, "orders"), ["o_orderkey"], strata=["o_orderpriority"], weight="w")
    return b.groupBy("o_orderpriority").agg(F.count("*").alias("n_rows"), F.sum("w").alias("n_drawn"))


@query("""
    SELECT o_orderpriority, CAST(greatest(1, floor(1000 * n / sum(n) OVER () + 0.5)) AS BIGINT) AS n_drawn
    FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
""")
def bootstrap_size(spark, d):
    b = bootstrap_rows(table(spark, d, "orders"), ["o_orderkey"], n=1000, strata=["o_orderpriority"])
    return b.groupBy("o_orderpriority").agg(F.count("*").alias("n_drawn"))


@query("SELECT count(DISTINCT o_custkey) AS clusters_drawn FROM orders")
def bootstrap_cluster(spark, d):
    b = bootstrap_rows(table(spark, d, "orders"), ["o_orderkey"], cluster=["o_custkey"], weight="w")
    return b.groupBy("o_custkey").agg(F.max("w").alias("w")).agg(F.sum("w").alias("clusters_drawn"))


# ----------------------------------------------------------------------------------- file round trips


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tallyframe/{uuid.uuid4().hex}-{name}"


@query("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def io_delimited_round_trip(spark, d):
    path = _path(spark, "customer.csv")
    write_delimited(table(spark, d, "customer"), path, order=["c_custkey"])
    return read_delimited(spark, path)


def _documents_strict(spark, d) -> DataFrame:
    path = _path(spark, "documents.tsv")
    write_delimited(table(spark, d, "documents").select("doc_id", "text", "lang"), path, delimiter="tab", order=["doc_id"])
    return read_delimited(spark, path, delimiter="tab", bindquotes="strict", stringcols=[2])


@query("SELECT CAST(doc_id AS INTEGER) AS doc_id, coalesce(text, '') AS text, lang FROM documents")
def io_delimited_quotes_strict(spark, d):
    return _documents_strict(spark, d)


@query("SELECT CAST(c_custkey AS INTEGER) AS v1, CASE WHEN c_custkey % 100 = 0 THEN 'Café ' || c_name ELSE c_name END AS v2 FROM customer")
def io_delimited_late_latin_byte(spark, d):
    """The first bytes that are not UTF-8 stand far beyond the head of the file."""
    path = _path(spark, "latin.csv")
    name = F.when(F.col("c_custkey") % 100 == 0, F.concat(F.lit("Café "), "c_name")).otherwise(F.col("c_name"))
    table(spark, d, "customer").select("c_custkey", name).coalesce(1).sortWithinPartitions("c_custkey").write.csv(path, encoding="ISO-8859-1")
    return read_delimited(spark, path, delimiter=",", varnames=None)


@query("SELECT CAST(o_orderkey AS INTEGER) AS v1, o_orderpriority AS v2, CASE WHEN o_orderkey % 100 = 0 THEN o_orderstatus ELSE '' END AS v3 FROM orders")
def io_delimited_late_wide_line(spark, d):
    """The first line with a third field stands far beyond the head of the file."""
    path = _path(spark, "wide.csv")
    last = F.when(F.col("o_orderkey") % 100 == 0, F.col("o_orderstatus"))
    lines = table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", last).alias("value"))
    lines.coalesce(1).sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return read_delimited(spark, path, delimiter=",", varnames=None)


def _orders_european(spark, d) -> DataFrame:
    path = _path(spark, "orders.csv")
    rows = table(spark, d, "orders")
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    write_delimited(rows.select("o_orderkey", text.alias("price")), path, delimiter=";", novarnames=True, quote=True, order=["o_orderkey"])
    out = read_delimited(spark, path, varnames=None, locale="de_DE")
    return out.select(F.col("v1").cast("int").alias("v1"), "v2")


@query("SELECT CAST(o_orderkey AS INTEGER) AS v1, round(o_totalprice, 2) AS v2 FROM orders WHERE o_orderkey BETWEEN 10 AND 40")
def io_delimited_european(spark, d):
    return _orders_european(spark, d).filter("v1 between 10 and 40")


@query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 9")
def io_delimited_ranges(spark, d):
    path = _path(spark, "nation.csv")
    write_delimited(table(spark, d, "nation"), path, order=["n_nationkey"])
    return read_delimited(spark, path, rowrange=(5, 11), colrange=(1, 2))


@query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, r_name AS n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def io_delimited_labels(spark, d):
    path = _path(spark, "labels.csv")
    labels = table(spark, d, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"))
    write_delimited(table(spark, d, "nation"), path, columns=["n_nationkey", "n_regionkey"], labels={"n_regionkey": labels})
    return read_delimited(spark, path)


def _orders_workbook(spark, d) -> DataFrame:
    path = _path(spark, "orders.xlsx")
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    write_xlsx(rows, path, order=["o_orderkey"])
    return read_xlsx(spark, path, firstrow=True).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM orders WHERE o_orderkey < 200")
def io_xlsx_round_trip(spark, d):
    return _orders_workbook(spark, d).filter("o_orderkey < 200")


@query("SELECT CAST(s_suppkey AS INTEGER) AS \"B\", s_name AS \"C\" FROM supplier WHERE s_suppkey BETWEEN 2 AND 5")
def io_xlsx_range(spark, d):
    path = _path(spark, "supplier.xlsx")
    write_xlsx(table(spark, d, "supplier").select("s_suppkey", "s_name"), path, cell="B3", firstrow=None, order=["s_suppkey"])
    low = table(spark, d, "supplier").filter("s_suppkey < 2").count()
    return read_xlsx(spark, path, cellrange=f"B{3 + low}:C{6 + low}")
