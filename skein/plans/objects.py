"""Object queries: pages by URL as an inventory, and literal header tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import hashing
from skein.operators import objects as O
from skein.registry import query

INVENTORY = "WITH o AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS key FROM pages)"


def _objects(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    key = F.regexp_replace("url", "^[a-z]+://", "")
    rows = p.groupBy(key.cast("binary").alias("key")).agg(F.max_by("html", "page_id").alias("html"), F.max("page_id").alias("n"))
    return rows.select("key", F.octet_length("html").cast("long").alias("size"), F.md5(F.col("html").cast("binary")).alias("etag"), (F.col("n") * 1000).alias("modified_at_ms"))


def _entry(df):
    return df.select("entry", "is_prefix", "objects", F.col("last_key").cast("string").alias("last_key"))


_FOLD = "SELECT coalesce(p, key) AS entry, p IS NOT NULL AS is_prefix, count(*) AS objects, max(key) AS last_key FROM (SELECT key, CASE WHEN contains(key[{n}:], '/') THEN key[1:{m}] || split_part(key[{n}:], '/', 1) || '/' END AS p FROM {t}) GROUP BY ALL"


@query("ob_list_delimiter", INVENTORY + _FOLD.format(n=1, m=0, t="o"))
def _(spark, sf):
    return _entry(O.listing(_objects(spark, sf), delimiter=b"/"))


@query("ob_list_page", INVENTORY + ", q AS (SELECT key FROM o WHERE starts_with(key, 'm.') AND key > 'm.ther' ORDER BY key LIMIT 40) " + _FOLD.format(n=3, m=2, t="q"))
def _(spark, sf):
    return _entry(O.listing(_objects(spark, sf), prefix=b"m.", delimiter=b"/", after=b"m.ther", max_keys=40))


@query("ob_list_keys", INVENTORY + "SELECT key AS entry FROM o WHERE starts_with(key, 'www.') ORDER BY key LIMIT 25")
def _(spark, sf):
    return O.listing(_objects(spark, sf), prefix=b"www.", max_keys=25).select("entry")


#: Range headers by page number: whole, from, last, beyond the end, of another unit, several, none, at the end, empty.
_HEADERS = ["bytes=0-3", "bytes=4-", "bytes=-3", "bytes=7-99999999", "items=0-1", "bytes=0-1,3-4", None, "at the end", "bytes=-0"]
_RANGE = """WITH p AS (SELECT page_id, page_id % 9 AS k, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
r AS (SELECT *, CASE WHEN k = 4 THEN 'invalid' WHEN k = 5 THEN 'multiple' WHEN k = 6 THEN 'full' WHEN k IN (7, 8) OR n = 0 OR (k = 1 AND n <= 4) OR (k = 3 AND n <= 7) THEN 'unsatisfiable' ELSE 'partial' END AS status FROM p)
SELECT page_id, status, CASE WHEN status = 'full' THEN 0 WHEN status = 'partial' THEN CASE k WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN greatest(n - 3, 0) ELSE 7 END END::BIGINT AS "start",
CASE WHEN status = 'full' THEN n WHEN status = 'partial' THEN CASE k WHEN 0 THEN least(4, n) ELSE n END END::BIGINT AS "end" FROM r"""


@query("ob_range", _RANGE)
def _(spark, sf):
    n = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    header = F.lit(None).cast("string")
    for k, h in enumerate(_HEADERS):
        header = F.when(F.col("page_id") % 9 == k, F.lit(h) if h != "at the end" else F.concat(F.lit("bytes="), n.cast("string"), F.lit("-"))).otherwise(header)
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", O.byte_range(header, n).alias("r"))
    return rows.select("page_id", "r.status", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


@query("ob_range_read", "SELECT page_id, hex(encode(html)[1:8]) AS head, hex(encode(html)[-8:]) AS tail FROM pages WHERE octet_length(encode(html)) >= 8")
def _(spark, sf):
    body = F.col("html").cast("binary")
    n = F.octet_length("html")

    def cut(header):
        r = O.byte_range(F.lit(header), n)
        return F.hex(F.substring(body, r["start"].cast("int") + 1, (r["end"] - r["start"]).cast("int")))

    return spark.read.parquet(f"{sf}/pages.parquet").filter(n >= 8).select("page_id", cut("bytes=0-7").alias("head"), cut("bytes=-8").alias("tail"))


D1, D2 = "Mon, 01 Jan 2024 00:00:00 GMT", "Wed, 03 Jan 2024 00:00:00 GMT"  # the object is of the 2nd


@query("ob_conditions", "SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(["ok", "ok", "failed", "failed", "ok", "failed", "not_modified", "not_modified", "ok", "not_modified"])) + " END AS result FROM pages")
def _(spark, sf):
    """Conditional reads of pages of one day, by their own tags and by dates before and after."""
    n, tag = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    own, weak, other = F.concat(F.lit('"'), tag, F.lit('"')), F.concat(F.lit('W/"'), tag, F.lit('"')), F.lit('"x"')
    none = F.lit(None).cast("string")
    # (if-match, if-unmodified, if-none-match, if-modified) by the last digit
    rules = [(None,) * 4, (F.concat(other, F.lit(", "), own), F.lit(D1), None, None), (other, None, None, None), (weak, None, None, None), (F.lit("*"), None, other, None), (None, F.lit(D1), None, None), (None, None, weak, None), (None, None, None, F.lit(D2)), (None, None, other, F.lit(D2)), (None, F.lit(D2), F.lit("*"), None)]
    heads = [none] * 4
    for k, rule in enumerate(rules):
        heads = [F.when(n % 10 == k, none if x is None else x).otherwise(h) for x, h in zip(rule, heads, strict=True)]
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", O.condition(tag, F.lit(1704153600), *heads).alias("result"))


@query("ob_etag", "SELECT page_id, md5(coalesce(html, '')) AS etag FROM pages")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", hashing.etag(F.coalesce("html", F.lit("")).cast("binary")).alias("etag"))


@query("ob_multipart_etag", "SELECT doc_id, md5(unhex(md5(lang) || md5(source))) || '-2' AS etag FROM documents")
def _(spark, sf):
    parts = F.array(F.md5(F.col("lang").cast("binary")), F.md5(F.col("source").cast("binary")))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", hashing.multipart_etag(parts).alias("etag"))


@query("ob_delete_batch", INVENTORY + "SELECT key FROM o WHERE NOT starts_with(key, 'www.')")
def _(spark, sf):
    o = _objects(spark, sf)
    return O.deleted(o, o.filter(F.col("key").startswith(F.lit(b"www.")))).select(F.col("key").cast("string").alias("key"))


@query("ob_copy", INVENTORY + "SELECT key, false AS copied FROM o UNION ALL SELECT 'copy/' || key, true FROM o WHERE starts_with(key, 'm.')")
def _(spark, sf):
    o = _objects(spark, sf)
    copies = o.filter(F.col("key").startswith(F.lit(b"m."))).select(F.col("key").alias("source"), F.concat(F.lit(b"copy/"), F.col("key")).alias("target"))
    return O.copied(o, copies, 5).select(F.col("key").cast("string").alias("key"), (F.col("modified_at_ms") == 5).alias("copied"))


@query("ob_list_parts", "SELECT number, size FROM (SELECT l_linenumber + l_orderkey % 100 AS number, arg_max(l_partkey, l_orderkey * 10 + l_linenumber) AS size FROM lineitem WHERE l_suppkey = 7 GROUP BY 1) WHERE number > 10 ORDER BY number LIMIT 30")
def _(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    parts = li.select(F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("upload"), (F.col("l_linenumber") + F.col("l_orderkey") % 100).alias("number"), F.col("l_partkey").alias("size"), F.lit("").alias("etag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sent"))
    return O.parts_page(parts, "u7", 10, 30).select("number", "size")


@query("ob_percent_decode", "SELECT doc_id, substr(text, 1, 60) || '+' AS text FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    raw = F.concat(F.replace(F.url_encode(F.substring("text", 1, 60)), F.lit("+"), F.lit("%20")), F.lit("+"))
    return spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL").select("doc_id", O.percent_decoded(raw).alias("text"))
