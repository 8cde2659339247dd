"""Queries of byte forms, copy headers, multipart state, and checked sums over the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import encodings as E
from skein.functions.predicates import has_prefix
from skein.operators import objects as O
from skein.operators import table as T
from skein.registry import query
from skein.sources.session import scratch


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sql_byte(x):
    return f"CASE WHEN {x} = 0 THEN '00FF' ELSE lpad(upper(hex({x})), 2, '0') END"


@query("fn_key_escape", f"SELECT l_orderkey, l_linenumber, {_sql_byte('l_orderkey % 3')} || {_sql_byte('l_linenumber')} || {_sql_byte('l_suppkey % 2')} || '0000' AS key FROM lineitem")
def fn_key_escape(spark, sf):
    """Keys of three bytes, zeros among them, as parts of longer keys."""
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    key = F.concat(byte(F.col("l_orderkey") % 3), byte(F.col("l_linenumber")), byte(F.col("l_suppkey") % 2))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.hex(E.escaped(key)).alias("key"))


@query("fn_decimal", "WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS n FROM orders) SELECT o_orderkey, CASE WHEN abs(n) < 10000000 THEN n END AS unscaled FROM v")
def fn_decimal(spark, sf):
    """Decimals of seven digits from big-endian bytes of several lengths; longer numbers have no value."""
    n = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1) * F.round(F.col("o_totalprice") * 100).cast("long")
    k = F.col("o_orderkey") % 3
    raw = F.unhex(F.lpad(F.hex(n), 16, "0"))
    raw = F.when(k == 0, raw).when(k == 1, F.substring(raw, -5, 5)).otherwise(F.concat(F.unhex(F.when(n < 0, "FF" * 12).otherwise("00" * 12)), raw))
    return _table(spark, sf, "orders").select("o_orderkey", E.unscaled(raw, 7).cast("long").alias("unscaled"))


@query("fn_base64url", "SELECT doc_id, rtrim(translate(base64(encode(md5(CAST(doc_id AS VARCHAR)) || source)), '+/', '-_'), '=') AS token, true AS back FROM documents")
def fn_base64url(spark, sf):
    """Tokens in base64 of URLs, and back."""
    raw = F.concat(F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("source")).cast("binary")
    return _table(spark, sf, "documents").select("doc_id", E.base64url(raw).alias("token"), (E.from_base64url(E.base64url(raw)) == raw).alias("back"))


@query("fn_variant_path", "SELECT p_partkey, p_partkey % 8 IN (0, 1, 2, 5) AS normal FROM part")
def fn_variant_path(spark, sf):
    """Paths of variant bounds, normal and not: names, indexes, escapes, leading zeros, too large an index, bad ends."""
    n = F.col("p_partkey").cast("string")
    kinds = [F.concat(F.lit("$['"), F.col("p_name"), F.lit("']")), F.concat(F.lit("$["), n, F.lit("]['a\\'b']")), F.lit("$['\\u0001\\n']"), F.concat(F.lit("$[0"), n, F.lit("]")), F.concat(F.lit("$.a"), n), F.lit("$"), F.lit("$['\\u0009']"), F.lit("$[9007199254740992]")]
    path = F.lit(None).cast("string")
    for i, x in enumerate(kinds):
        path = F.when(F.col("p_partkey") % 8 == i, x).otherwise(path)
    return _table(spark, sf, "part").select("p_partkey", E.normalized_path(path).alias("normal"))


@query("fn_checked_sum", "SELECT o_orderkey, CASE WHEN 9223372036854775807::HUGEINT - o_custkey + o_orderkey <= 9223372036854775807 THEN (9223372036854775807::HUGEINT - o_custkey + o_orderkey)::BIGINT END AS total FROM orders")
def fn_checked_sum(spark, sf):
    """Sums near the end of long: none where they overflow."""
    return _table(spark, sf, "orders").select("o_orderkey", E.checked_sum(F.lit(2**63 - 1) - F.col("o_custkey"), F.col("o_orderkey")).alias("total"))


@query("fn_prefix_successor", "SELECT page_id FROM pages WHERE starts_with(regexp_replace(url, '^[a-z]+://', ''), 'www.')")
def fn_prefix_successor(spark, sf):
    """Keys with a prefix, as the range from it to its successor."""
    key = F.regexp_replace("url", "^[a-z]+://", "").cast("binary")
    return _table(spark, sf, "pages").filter(has_prefix(key, b"www.")).select("page_id")


@query("tb_unified_fields", "WITH s AS (SELECT l_suppkey % 7 AS spec, 1000 + l_partkey % 40 AS field_id, CASE WHEN l_partkey % 40 = 3 THEN l_suppkey % 2 ELSE l_partkey % 40 END AS source, CASE WHEN l_suppkey % 2 = 0 OR l_partkey % 5 = 4 THEN 'void' WHEN l_partkey % 40 = 7 AND l_suppkey % 3 = 0 THEN 'day' ELSE 'month' END AS transform FROM lineitem) SELECT field_id, min(source) AS source, coalesce(min(transform) FILTER (transform <> 'void'), 'void') AS transform, CASE WHEN count(DISTINCT source) > 1 THEN 'source' WHEN count(DISTINCT transform) FILTER (transform <> 'void') > 1 THEN 'transform' END AS problem FROM s GROUP BY field_id")
def tb_unified_fields(spark, sf):
    """The partition fields of many specs as one type."""
    p, s = F.col("l_partkey") % 40, F.col("l_suppkey")
    specs = _table(spark, sf, "lineitem").select((s % 7).alias("spec_id"), (p + 1000).alias("field_id"), F.when(p == 3, s % 2).otherwise(p).alias("source"), F.when((s % 2 == 0) | (F.col("l_partkey") % 5 == 4), "void").when((p == 7) & (s % 3 == 0), "day").otherwise("month").alias("transform"))
    return T.unified_fields(specs)


@query("tb_summary_containment", "WITH v AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders), a AS (SELECT k, bool_or(v IS NULL) AS n, min(v) AS lo, max(v) AS up FROM v GROUP BY k) SELECT k AS custkey FROM a WHERE (k % 4 = 1 AND n) OR (k % 4 = 2 AND up IS NOT NULL AND lo < up)")
def tb_summary_containment(spark, sf):
    """Partition summaries that do not say what the files have: a null left out, a bound too tight."""
    k = F.col("o_custkey")
    values = _table(spark, sf, "orders").select(k.alias("custkey"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("value"))
    k = F.col("custkey")
    real = values.groupBy(k).agg(F.bool_or(F.col("value").isNull()).alias("n"), F.min("value").alias("lo"), F.max("value").alias("up"))
    said = real.select(k, (F.col("n") & (k % 4 != 1)).alias("contains_null"), F.lit(None).cast("boolean").alias("contains_nan"), F.col("lo").alias("lower"), F.when((k % 4 == 2), F.col("lo")).otherwise(F.col("up")).alias("upper"))
    return T.outside(values, said, "custkey")


# --- objects ----------------------------------------------------------------------------------------------------


@query("ob_copy_source", "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'unsupported' ELSE 'invalid' END AS status, CASE WHEN page_id % 7 < 2 THEN 'b' || page_id END AS bucket, CASE WHEN page_id % 7 < 2 THEN 'dir/' || url END AS key FROM pages")
def ob_copy_source(spark, sf):
    """Sources of copies: percent-encoded keys, versions, bad escapes, no key, no bucket, too long a bucket."""
    n = F.col("page_id")
    key = F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20"))
    b = F.concat(F.lit("b"), n.cast("string"))
    kinds = [F.concat(F.lit("/"), b, F.lit("/dir/"), key), F.concat(b, F.lit("/dir%2F"), key), F.concat(b, F.lit("/k?versionId=3")), F.concat(b, F.lit("/k%2"), F.lit("G")), b, F.lit("//k"), F.concat(F.repeat(F.lit("b"), F.lit(64)), F.lit("/k"))]
    header = F.lit(None).cast("string")
    for i, x in enumerate(kinds):
        header = F.when(n % 7 == i, x).otherwise(header)
    s = O.copy_source(header)
    return _table(spark, sf, "pages").select("page_id", s["status"].alias("status"), s["bucket"].cast("string").alias("bucket"), s["key"].cast("string").alias("key"))


@query("ob_part_copy", "WITH p AS (SELECT o_orderkey AS k, o_custkey * 10000::BIGINT AS n, o_orderkey % 1000 * 1000::BIGINT AS a FROM orders) SELECT k AS upload, CASE WHEN n > 5242880 AND k % 3 <> 2 AND a + 999 < n THEN a END AS \"start\", CASE WHEN n > 5242880 AND k % 3 <> 2 AND a + 999 < n THEN a + 1000 END AS \"end\" FROM p")
def ob_part_copy(spark, sf):
    """Ranges of part copies: whole ranges within sources that are large enough."""
    k, a = F.col("o_orderkey"), F.col("o_orderkey") % 1000 * 1000
    header = F.concat(F.lit("bytes="), a.cast("string"), F.lit("-"), F.when(k % 3 == 2, "").otherwise((a + 999).cast("string")))
    r = O.part_range(header, F.col("o_custkey").cast("long") * 10000)
    return _table(spark, sf, "orders").select(k.alias("upload"), r["start"].alias("start"), r["end"].alias("end"))


_PARTS = """WITH p AS (SELECT l_orderkey AS upload, l_linenumber AS number, arg_max(l_partkey, l_suppkey * 1000000 + l_partkey) * 10000::BIGINT AS size, md5(CAST(arg_max(l_partkey, l_suppkey * 1000000 + l_partkey) AS VARCHAR)) AS etag FROM lineitem GROUP BY ALL),
c AS (SELECT *, upload % 5 = 4 AND number = 2 AS wrong, CASE WHEN upload % 5 = 3 THEN -number ELSE number END AS place FROM p),
g AS (SELECT upload, bool_or(wrong) AS wrong, count(*) AS n, sum(size)::BIGINT AS size, string_agg(etag, '' ORDER BY number) AS tags, bool_or(size < 5242880 AND number < m) AS small FROM (SELECT *, max(number) OVER (PARTITION BY upload) AS m FROM c) GROUP BY upload)
SELECT upload, CASE WHEN wrong THEN 'part' WHEN upload % 5 = 3 AND n > 1 THEN 'order' WHEN small THEN 'size' END AS problem, CASE WHEN NOT (wrong OR upload % 5 = 3 AND n > 1 OR small) THEN size END AS size, CASE WHEN NOT (wrong OR upload % 5 = 3 AND n > 1 OR small) THEN md5(unhex(tags)) || '-' || n END AS etag FROM g"""


@query("ob_complete_uploads", _PARTS)
def ob_complete_uploads(spark, sf):
    """Orders as uploads whose lines are parts: completed in order, in the wrong one, with a wrong tag, with small parts."""
    li = _table(spark, sf, "lineitem")
    tag = lambda c: F.md5(c.cast("string").cast("binary"))
    parts = li.select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("number"), (F.col("l_partkey").cast("long") * 10000).alias("size"), tag(F.col("l_partkey")).alias("etag"), (F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("sent"))
    newest = O.newest_parts(parts)
    place = F.when(F.col("upload") % 5 == 3, -F.col("number")).otherwise(F.col("number"))
    chosen = newest.select("upload", place.alias("place"), "number", F.when((F.col("upload") % 5 == 4) & (F.col("number") == 2), "0").otherwise(F.col("etag")).alias("etag"))
    return O.completed(parts, chosen)


@query("ob_list_uploads", "SELECT o_orderpriority AS key, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS upload FROM orders WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND lpad(CAST(o_orderkey AS VARCHAR), 9, '0') > '000000500') ORDER BY 1, 2 LIMIT 700")
def ob_list_uploads(spark, sf):
    """A page of uploads in progress, after a key and an upload of it."""
    uploads = _table(spark, sf, "orders").select(F.col("o_orderpriority").cast("binary").alias("key"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("upload"))
    return O.uploads_page(uploads, after=(b"2-HIGH", "000000500"), limit=700).select(F.col("key").cast("string").alias("key"), "upload")


@query("src_file_kinds", "SELECT * FROM (VALUES ('avro'), ('orc'), ('parquet'), ('unknown')) v(kind)")
def src_file_kinds(spark, sf):
    """Files written in four formats, known by their first and last bytes; the ORC rows read back."""
    from skein.sources import avro, files

    df, at = _table(spark, sf, "supplier").select("s_suppkey", "s_name").coalesce(1), scratch(spark, "kinds")
    df.write.parquet(f"{at}/parquet")
    df.write.orc(f"{at}/orc")
    df.write.csv(f"{at}/csv")
    avro.write(df, f"{at}/avro")
    if spark.read.orc(f"{at}/orc").exceptAll(df).count():
        raise AssertionError("the ORC rows differ")
    found = None
    for name in ("parquet", "orc", "csv", "avro"):
        part = files.kinds(spark, f"{at}/{name}", f"*.{name}")
        found = part if found is None else found.union(part)
    return found.select("kind")
