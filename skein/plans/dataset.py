"""Dataset queries over documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import hashing
from skein.functions.predicates import ALL, Explicit, FieldMatch, Keyword, Not, Prefix, Range
from skein.operators import dataset as D
from skein.registry import query

FIELDS = ["text", "lang", "source"]


def _id():
    return F.col("sample_id").cast("string").alias("id")


def _docs(spark, sf):
    return D.documents(spark, sf)


def _selected(name, predicate, where):
    @query(name, f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE {where}")
    def run(spark, sf):
        return D.select(_docs(spark, sf), predicate, FIELDS).select(_id())


V = "CAST(doc_id AS VARCHAR)"
_selected("ds_all", ALL, "true")
_selected("ds_prefix", Prefix(b"12"), f"starts_with({V}, '12')")
_selected("ds_range", Range(b"15", b"3"), f"{V} >= '15' AND {V} < '3'")
_selected("ds_explicit", Explicit((b"3", b"77", b"150")), f"{V} IN ('3', '77', '150')")
_selected("ds_keyword", Keyword(b"er the"), "contains(text, 'er the') OR contains(lang, 'er the') OR contains(source, 'er the')")
_selected("ds_field_match", FieldMatch("lang", b"de"), "lang = 'de'")
_selected("ds_and_or_not", (FieldMatch("lang", b"en") | FieldMatch("lang", b"fr")) & ~Prefix(b"1") & ~Keyword(b"casino"), f"lang IN ('en', 'fr') AND NOT starts_with({V}, '1') AND NOT contains(text, 'casino')")


@query("ds_not_missing", "SELECT CAST(d.doc_id AS VARCHAR) AS id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.toxic = 1, false)")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left")
    samples = docs.select(F.col("doc_id").cast("string").cast("binary").alias("sample_id"), F.col("toxic").cast("string").cast("binary").alias("toxic"))
    return D.select(samples, Not(FieldMatch("toxic", b"1")), ["toxic"]).select(_id())


@query("ds_projection", "SELECT CAST(doc_id AS VARCHAR) AS id, lang, source FROM documents WHERE source = 'src3'")
def _(spark, sf):
    return D.select(_docs(spark, sf), FieldMatch("source", b"src3"), FIELDS).select(_id(), *(F.col(c).cast("string").alias(c) for c in D.projection(["lang", "source"])))


LAYERS = """
WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS id, * FROM documents),
f AS (
  SELECT id, 'text' AS field, 'inline' AS kind, text AS value, 1 AS depth FROM s
  UNION ALL SELECT id, 'lang', 'inline', lang, 1 FROM s
  UNION ALL SELECT id, 'source', 'chunk', NULL, 1 FROM s WHERE doc_id % 3 = 0
  UNION ALL SELECT id, 'lang', 'inline', 'xx', 0 FROM s WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0
  UNION ALL SELECT id, 'lang', 'tombstone', NULL, 0 FROM s WHERE doc_id % 7 = 0),
e AS (SELECT id, field, arg_min(kind, depth) AS kind, arg_min(coalesce(value, ''), depth) AS value FROM f GROUP BY id, field)
"""


def _layers(spark, sf):
    """A child snapshot of two over documents: overrides and tombstones of lang, chunks of source below."""
    df = spark.read.parquet(f"{sf}/documents.parquet").withColumn("sample_id", F.col("doc_id").cast("string").cast("binary"))
    n = F.col("doc_id")

    def layer(snapshot, field, kind, value, where):
        return df.filter(where).select(F.lit(snapshot).alias("snapshot"), "sample_id", F.lit(field).alias("field"), F.lit(kind).alias("kind"), value.cast("binary").alias("value"))

    fields = layer("base", "text", "inline", F.col("text"), F.lit(True)).union(layer("base", "lang", "inline", F.col("lang"), F.lit(True))).union(layer("base", "source", "chunk", F.lit(None), n % 3 == 0)).union(layer("child", "lang", "inline", F.lit("xx"), (n % 5 == 0) & (n % 7 != 0))).union(layer("child", "lang", "tombstone", F.lit(None), n % 7 == 0))
    members = df.select(F.lit("child").alias("snapshot"), "sample_id")
    snapshots = spark.createDataFrame([("base", None), ("child", "base")], "id string, parent string")
    return members, fields, D.ancestors(snapshots, "child")


@query("ds_overlay", LAYERS + "SELECT id, field, kind, md5(value) AS digest FROM e")
def _(spark, sf):
    return D.effective(*_layers(spark, sf)).select(_id(), "field", "kind", F.md5(F.coalesce("value", F.lit("").cast("binary"))).alias("digest"))


@query("ds_overlay_select", LAYERS + "SELECT id FROM e WHERE field = 'lang' AND NOT (kind = 'inline' AND value = 'en')")
def _(spark, sf):
    overlay = D.effective(*_layers(spark, sf))
    samples = overlay.groupBy("sample_id").agg(D.visible("lang", overlay))
    return D.select(samples, Not(FieldMatch("lang", b"en")), ["lang"]).select(_id())


MATRIX = "SELECT id, max(kind) FILTER (field = 'text') AS text, max(kind) FILTER (field = 'lang') AS lang, max(kind) FILTER (field = 'source') AS source FROM e"


@query("ds_projection_matrix", f"{LAYERS} {MATRIX} GROUP BY id")
def _(spark, sf):
    members, fields, chain = _layers(spark, sf)
    return D.matrix(members, D.effective(members, fields, chain), FIELDS).select(_id(), *FIELDS)


@query("ds_exact_matrix", f"{LAYERS} {MATRIX} WHERE id IN ('0', '7', '15', '35', '42') GROUP BY id")
def _(spark, sf):
    members, fields, chain = _layers(spark, sf)
    few = members.filter(F.col("sample_id").isin([F.lit(x) for x in (b"0", b"7", b"15", b"35", b"42")]))
    return D.matrix(few, D.effective(few, fields.join(F.broadcast(few.select("sample_id")), "sample_id", "left_semi"), chain), FIELDS).select(_id(), *FIELDS)


@query("ds_contains", "SELECT p AS probe, EXISTS (SELECT 1 FROM documents WHERE CAST(doc_id AS VARCHAR) = p) AS found FROM (VALUES ('5'), ('0005'), ('99999999')) v(p)")
def _(spark, sf):
    probes = spark.createDataFrame([("5",), ("0005",), ("99999999",)], "probe string")
    hits = _docs(spark, sf).select(F.col("sample_id").cast("string").alias("probe")).join(F.broadcast(probes), "probe", "left_semi").withColumn("found", F.lit(True))
    return probes.join(hits, "probe", "left").select("probe", F.coalesce("found", F.lit(False)).alias("found"))


@query("ds_preview", "SELECT CAST(doc_id AS VARCHAR) AS id, hex(encode(text)[1:16]) AS head, octet_length(encode(text))::BIGINT AS length, md5(text) AS md5, 'present' AS state, octet_length(encode(text)) > 16 AS truncated FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select(_id(), D.preview(F.col("text"), 16).alias("p")).select("id", F.hex("p.bytes").alias("head"), "p.length", "p.md5", "p.state", "p.truncated")


@query("ds_page", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE CAST(doc_id AS VARCHAR) > '42' ORDER BY 1 LIMIT 20")
def _(spark, sf):
    return D.page(_docs(spark, sf), "sample_id", bytearray(b"42"), 20).select(_id())


def _tree(spark, sf):
    """Customers as snapshots: the parent of n is n div 2."""
    n = F.col("c_custkey").cast("long")
    return spark.read.parquet(f"{sf}/customer.parquet").select(n.alias("id"), F.when(n > 1, F.expr("c_custkey div 2")).alias("parent"))


@query("ds_ancestors", "WITH RECURSIVE w AS (SELECT max(c_custkey) AS id, 0 AS depth FROM customer UNION ALL SELECT id // 2, depth + 1 FROM w WHERE id > 1) SELECT id, depth FROM w")
def _(spark, sf):
    tree = _tree(spark, sf)
    return D.ancestors(tree, tree.agg(F.max("id")).first()[0])


def _chain(spark):
    return spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "d")], "id string, parent string")


@query("ds_children", "SELECT coalesce(CASE WHEN c_custkey > 1 THEN c_custkey // 2 END, 0) AS parent, count(*) AS children, min(c_custkey) AS least FROM customer GROUP BY 1")
def _(spark, sf):
    """The children of every snapshot, and the roots (parent 0)."""
    return _tree(spark, sf).groupBy(F.coalesce("parent", F.lit(0)).alias("parent")).agg(F.count("*").alias("children"), F.min("id").alias("least"))


@query("ds_retention", "WITH c AS (SELECT DISTINCT 'chunk' || (doc_id % 50) AS chunk, chr(97 + CAST(doc_id % 5 AS INT)) AS snapshot, doc_id % 50 = 7 AS ext FROM documents), lost AS (SELECT 'c' AS id) SELECT 'snapshot' AS what, id FROM lost UNION ALL SELECT 'chunk', chunk FROM (SELECT DISTINCT chunk FROM c WHERE NOT ext EXCEPT SELECT chunk FROM c WHERE snapshot <> 'c')")
def _(spark, sf):
    n = F.col("doc_id")
    chunks = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("chunk"), (n % 50).cast("string")).alias("chunk"), F.chr((n % 5 + 97).cast("int")).alias("snapshot"), (n % 50 == 7).alias("external")).distinct()
    lost, reclaim = D.retention(_chain(spark), chunks, spark.createDataFrame([("e",)], "id string"))
    return lost.select(F.lit("snapshot").alias("what"), "id").union(reclaim.select(F.lit("chunk"), "chunk"))


SNAP = bytes(range(16))
SQL_SNAP = "".join(f"\\x{b:02X}" for b in SNAP)


@query("ds_shuffle_group", f"WITH g AS (SELECT CAST(doc_id AS VARCHAR) AS id, (row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1) // 64 AS grp FROM documents) SELECT id, grp AS \"group\", grp * 64 + row_number() OVER (PARTITION BY grp ORDER BY md5('\\x07\\x00\\x00\\x00\\x00\\x00\\x00\\x00{SQL_SNAP}'::BLOB || encode(id)), id) - 1 AS ordinal FROM g")
def _(spark, sf):
    return D.group_shuffle(_docs(spark, sf).select("sample_id"), 7, SNAP, 64).select(_id(), "group", "ordinal")


@query("ds_shuffle_global", f"SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY md5('\\x07\\x00\\x00\\x00\\x00\\x00\\x00\\x00\\x02\\x00\\x00\\x00\\x00\\x00\\x00\\x00{SQL_SNAP}'::BLOB || encode(CAST(doc_id AS VARCHAR))), CAST(doc_id AS VARCHAR)) - 1 AS ordinal FROM documents")
def _(spark, sf):
    return D.global_shuffle(_docs(spark, sf).select("sample_id"), 7, 2, SNAP).select(_id(), "ordinal")


@query("ds_prefix_groups", "SELECT split_part(source || '-' || doc_id, '-', 1) AS prefix, count(*) AS n, min(source || '-' || doc_id) AS first FROM documents GROUP BY 1")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).cast("binary").alias("sample_id"))
    return D.prefix_groups(df).agg(F.count("*").alias("n"), F.min(F.col("sample_id").cast("string")).alias("first"))


@query("ds_worker_partition", "SELECT CAST(doc_id AS VARCHAR) AS id, n AS ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS n FROM documents WHERE lang = 'en') WHERE n % 6 = 3")
def _(spark, sf):
    samples = D.select(_docs(spark, sf), FieldMatch("lang", b"en"), FIELDS).select("sample_id")
    return D.shard(D.numbered(samples, "sample_id"), 1, 3, 1, 2).select(_id(), "ordinal")


@query("ds_batches", "SELECT n // 100 AS batch, count(*) AS n, min(n) AS first, max(n) + 1 AS \"end\" FROM (SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS n FROM documents) GROUP BY 1")
def _(spark, sf):
    rows = D.batches(D.numbered(_docs(spark, sf).select("sample_id"), "sample_id"), 100)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), (F.max("ordinal") + 1).alias("end"))


@query("ds_window_top", "SELECT id, n AS ordinal FROM (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS n FROM documents) WHERE n BETWEEN 50 AND 79")
def _(spark, sf):
    few = _docs(spark, sf).select("sample_id").orderBy("sample_id").offset(50).limit(30)
    return D.numbered(few, "sample_id").select(_id(), (F.col("ordinal") + 50).alias("ordinal"))


def split_sql(total: int, seed: int = 7) -> str:
    tag = "".join(f"\\x{b:02X}" for b in hashing.SPLIT_DOMAIN + seed.to_bytes(8, "big"))
    size = "unhex(printf('%08x', octet_length(encode(CAST(doc_id AS VARCHAR)))))"
    return f"CAST(CAST('0x' || substr(sha256('{tag}'::BLOB || {size} || encode(CAST(doc_id AS VARCHAR))), 1, 16) AS UBIGINT)::HUGEINT * {total} // 18446744073709551616 AS BIGINT)"


WEIGHTS = [("train", 8), ("validation", 1), ("test", 1)]
SPLIT = f"CASE WHEN {split_sql(10)} < 8 THEN 'train' WHEN {split_sql(10)} < 9 THEN 'validation' ELSE 'test' END"


@query("ds_weighted_split", f"SELECT CAST(doc_id AS VARCHAR) AS id, {split_sql(4294967295)} AS bucket, {SPLIT} AS split FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select(_id(), hashing.split_bucket(F.col("sample_id"), 7, 2**32 - 1).alias("bucket"), D.weighted_split(F.col("sample_id"), WEIGHTS, 7).alias("split"))


def _members(spark, sf):
    """Selection splits that overlap and leave some out: long texts, and texts in English."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").cast("binary").alias("sample_id"), "lang", "n_chars")
    long, english = df.filter("n_chars >= 3000").withColumn("split", F.lit("long")), df.filter("lang = 'en'").withColumn("split", F.lit("english"))
    return df.select("sample_id"), long.union(english).select("split", "sample_id")


MEMBERS = "WITH m AS (SELECT doc_id, (n_chars >= 3000)::INT + (lang = 'en')::INT AS c FROM documents)"


@query("ds_split_validation", f"{MEMBERS} SELECT count(*) AS scanned, count(*) FILTER (c > 0) AS assigned, count(*) FILTER (c = 0) AS unassigned, count(*) FILTER (c > 1) AS overlapping, (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT CAST(doc_id AS VARCHAR) AS i FROM m WHERE c = 0 ORDER BY 1 LIMIT 20)) AS unassigned_ids, (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT CAST(doc_id AS VARCHAR) AS i FROM m WHERE c > 1 ORDER BY 1 LIMIT 20)) AS overlapping_ids FROM m")
def _(spark, sf):
    out = D.split_report(*_members(spark, sf))
    return out.select("scanned", "assigned", "unassigned", "overlapping", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("unassigned_ids", "overlapping_ids")))


@query("ds_split_policy", f"{MEMBERS}, r AS (SELECT count(*) FILTER (c = 0) AS u, count(*) FILTER (c > 1) AS o FROM m) SELECT o = 0 AS disjoint, u = 0 AS overlap_complete, true AS overlap_partial FROM r")
def _(spark, sf):
    r = D.split_report(*_members(spark, sf))
    return r.select(D.satisfied(r).alias("disjoint"), D.satisfied(r, overlap_allowed=True, unassigned_allowed=False).alias("overlap_complete"), D.satisfied(r, overlap_allowed=True).alias("overlap_partial"))


@query("ds_split_counts", "SELECT 'long' AS split, count(*) AS n FROM documents WHERE n_chars >= 3000 UNION ALL SELECT 'english', count(*) FROM documents WHERE lang = 'en'")
def _(spark, sf):
    return _members(spark, sf)[1].groupBy("split").agg(F.count("*").alias("n"))


@query("ds_split_semi_join", f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE {SPLIT} = 'test' AND lang = 'en'")
def _(spark, sf):
    docs = _docs(spark, sf)
    frozen = docs.filter(D.weighted_split(F.col("sample_id"), WEIGHTS, 7) == "test").select("sample_id")
    return D.select(docs, FieldMatch("lang", b"en"), FIELDS).join(frozen, "sample_id", "left_semi").select(_id())


@query("ds_compose_upsert_remove", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 = 3 THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE (lang = 'en' OR doc_id % 10 = 3) AND doc_id % 11 <> 0 OR doc_id % 10 = 3 AND doc_id % 11 <> 0 UNION ALL SELECT 'new', 'yy', 'src'")
def _(spark, sf):
    parent = _docs(spark, sf).select("sample_id", "lang", "source")
    n = F.coalesce(F.col("sample_id").cast("string").try_cast("long"), F.lit(-1))
    upserts = parent.filter((n % 10 == 3) & (n % 11 != 0)).select("sample_id", F.lit("xx").cast("binary").alias("lang"), F.lit(None).cast("binary").alias("source"))
    upserts = upserts.union(spark.createDataFrame([(bytearray(b"new"), bytearray(b"yy"), bytearray(b"src"))], upserts.schema))
    out = D.compose(D.select(parent, FieldMatch("lang", b"en"), ["lang", "source"]), parent, upserts, parent.filter(n % 11 == 0).select("sample_id"), ["lang", "source"])
    return out.select(_id(), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


@query("ds_snapshot_summary", f"{LAYERS} SELECT count(DISTINCT field) AS fields, count(DISTINCT id) AS samples, count(*) AS locators FROM e")
def _(spark, sf):
    overlay = D.effective(*_layers(spark, sf))
    return overlay.agg(F.count_distinct("field").alias("fields"), F.count_distinct("sample_id").alias("samples"), F.count("*").alias("locators"))


@query("ds_payload_verify", "SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 9 <> 0 AS ok FROM documents")
def _(spark, sf):
    df = _docs(spark, sf)
    n = F.col("sample_id").cast("string").cast("long")
    length = F.octet_length("text") + F.when(n % 9 == 0, 1).otherwise(0)
    return df.select(_id(), hashing.verified(F.col("text"), F.md5("text"), length).alias("ok"))


@query("ds_snapshot_alias", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'l' WHEN 1 THEN 's' WHEN 2 THEN md5(CAST(doc_id AS VARCHAR)) ELSE '' END AS id FROM documents")
def _(spark, sf):
    """Names of snapshots: two aliases, whole lower-case ids, and what is neither."""
    n, own = F.col("doc_id"), F.md5(F.col("doc_id").cast("string").cast("binary"))
    name = F.when(n % 5 == 0, "latest").when(n % 5 == 1, "stable").when(n % 5 == 2, own).when(n % 5 == 3, F.concat(F.lit("A"), F.upper(F.substring(own, 2, 31)))).otherwise(F.substring(own, 1, 31))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce(D.snapshot_id(name, F.lit("l"), F.lit("s")), F.lit("")).alias("id"))


READ = f"WITH m AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS n FROM documents WHERE lang = 'en' AND NOT contains(text, 'casino') AND {SPLIT} = 'train'), g AS (SELECT *, n // 32 AS grp FROM m), o AS (SELECT *, grp * 32 + row_number() OVER (PARTITION BY grp ORDER BY md5('\\x07\\x00\\x00\\x00\\x00\\x00\\x00\\x00{SQL_SNAP}'::BLOB || encode(CAST(doc_id AS VARCHAR))), CAST(doc_id AS VARCHAR)) - 1 AS ordinal FROM g)"


def _read(spark, sf):
    """Bind, select, semi-join the split, shuffle in groups and take worker 0 of 2."""
    docs = _docs(spark, sf)
    train = docs.filter(D.weighted_split(F.col("sample_id"), WEIGHTS, 7) == "train").select("sample_id")
    samples = D.select(docs, FieldMatch("lang", b"en") & ~Keyword(b"casino"), FIELDS).join(train, "sample_id", "left_semi")
    return D.shard(D.group_shuffle(samples.select("sample_id", "lang", "source"), 7, SNAP, 32), 0, 1, 0, 2)


@query("ds_read_page", f"{READ} SELECT CAST(doc_id AS VARCHAR) AS id, ordinal, ordinal // 8 AS batch, lang, source FROM o WHERE ordinal % 2 = 0")
def _(spark, sf):
    return D.batches(_read(spark, sf), 8).select(_id(), "ordinal", "batch", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


@query("ds_flagship", f"WITH m AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS n FROM documents WHERE lang = 'en' AND NOT contains(text, 'casino') AND NOT contains(source, 'casino') AND {SPLIT} = 'train') SELECT CAST(doc_id AS VARCHAR) AS id, n AS ordinal, lang, source FROM m WHERE n % 2 = 0")
def _(spark, sf):
    samples = D.select(_docs(spark, sf), FieldMatch("lang", b"en") & ~Keyword(b"casino"), FIELDS).filter(D.weighted_split(F.col("sample_id"), WEIGHTS, 7) == "train")
    rows = D.shard(D.numbered(samples.select("sample_id", "lang", "source"), "sample_id"), 0, 1, 0, 2)
    return rows.select(_id(), "ordinal", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


# --- delivery, cursors, revisions -------------------------------------------------------------------------------


def _numbered(spark, sf):
    return D.numbered(_docs(spark, sf), "sample_id")


@query(
    "ds_frames",
    "WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS id, encode(text) AS t, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT id, n, t, unnest(range(greatest(1, (octet_length(t) + 999) // 1000))) AS chunk FROM m) SELECT n // 64 AS batch, id, chunk::INT AS chunk, chunk * 1000 AS \"offset\", octet_length(t[chunk * 1000 + 1:chunk * 1000 + 1000])::BIGINT AS length, md5(t[chunk * 1000 + 1:chunk * 1000 + 1000]) AS md5 FROM c",
)
def _(spark, sf):
    """All texts in frames of 1000 bytes with digests, 64 samples to a batch."""
    samples = D.numbered(_docs(spark, sf).filter("text IS NOT NULL"), "sample_id")
    return D.frames(samples, ["text"], 64, 1000).select("batch", _id(), "chunk", "offset", "length", "md5")


@query("ds_cursor_resume", "SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS ordinal FROM documents QUALIFY ordinal >= 2 * 32 + 7")
def _(spark, sf):
    """What a confirmed cursor in the third group leaves to read."""
    from skein.operators.cursor import ReadCursor

    plan = {"order": "sample_id", "group": 32}
    cursor = ReadCursor.start(plan, "s").confirmed(plan, "s", 2, 7)
    return cursor.rest(_numbered(spark, sf), 32).select(_id(), "ordinal")


def _reports(spark, sf):
    docs = _docs(spark, sf)
    n = F.col("sample_id").cast("string").cast("long")
    members = docs.filter(n % 5 != 0).select("sample_id", F.lit("a").alias("split")).union(docs.filter(n % 7 == 0).select("sample_id", F.lit("b")))
    return docs.withColumn("part", n % 3), members


@query(
    "ds_split_report_merge",
    "WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, (CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS c FROM documents) SELECT count(*) AS scanned, count(*) FILTER (c > 0) AS assigned, count(*) FILTER (c = 0) AS unassigned, count(*) FILTER (c > 1) AS overlapping, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM c WHERE c = 0 ORDER BY id LIMIT 20)) AS none, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM c WHERE c > 1 ORDER BY id LIMIT 20)) AS several FROM c",
)
def _(spark, sf):
    """Reports of three parts of the samples, merged."""
    docs, members = _reports(spark, sf)
    parts = [D.split_report(mine, members.join(mine.select("sample_id"), "sample_id", "left_semi")) for mine in (docs.filter(F.col("part") == k) for k in range(3))]
    merged = D.merged_reports(parts[0].union(parts[1]).union(parts[2]))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return merged.select("scanned", "assigned", "unassigned", "overlapping", text(F.col("unassigned_ids")).alias("none"), text(F.col("overlapping_ids")).alias("several"))


@query("ds_manifest_digest", "SELECT lang, count(*) AS samples, sum(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(31) || coalesce(source, chr(0))), 1, 15))::UBIGINT)::VARCHAR AS digest FROM documents GROUP BY lang")
def _(spark, sf):
    """A digest of each language's samples that no order or partitioning changes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.groupBy("lang").agg(F.count("*").alias("samples"), D.digest(docs, "doc_id", "source").cast("string").alias("digest"))


def _revisions(spark, sf):
    """Two snapshots' split revisions: the first has rules, the second inherits one split."""
    from skein.operators.catalog import Files
    from skein.operators.splits import Inherited, Splits
    from skein.sources.session import scratch

    docs, splits = _docs(spark, sf), Splits(Files(spark, scratch(spark, "splits")))
    n = F.col("sample_id").cast("string").cast("long")
    first = splits.prepare("a", docs, {"english": F.col("lang") == F.lit(b"en"), "third": n % 3 == 0}, overlap_allowed=True)
    splits.select("a", first["revision"], 0)
    pinned = splits.head("a")["revision"]
    splits.prepare("b", docs.filter(n % 2 == 0), {"kept": Inherited("a", pinned, "third"), "rest": n % 3 != 0}, parent="a", unassigned_allowed=False)
    return splits


@query("ds_split_revision", "SELECT 'a' AS snapshot, 'english' AS split, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'en' UNION ALL SELECT 'a', 'third', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'b', 'kept', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT 'b', 'rest', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0")
def _(spark, sf):
    """The frozen members of every split of two revisions, one of them inherited."""
    splits, out = _revisions(spark, sf), None
    for snapshot, name in (("a", "english"), ("a", "third"), ("b", "kept"), ("b", "rest")):
        part = splits.members(snapshot, splits.revisions(snapshot)[-1], name).select(F.lit(snapshot).alias("snapshot"), F.lit(name).alias("split"), _id())
        out = part if out is None else out.union(part)
    return out


@query("ds_split_page", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 3 = 0 AND CAST(doc_id AS VARCHAR) > '5' ORDER BY 1 LIMIT 40")
def _(spark, sf):
    """A page of a split's members, after an id."""
    return _revisions(spark, sf).members("a", 1, "third", after=b"5", limit=40).select(_id())


@query("ds_bound_read", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 3 = 0 QUALIFY row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) > 50")
def _(spark, sf):
    """A read by alias and split whose first batch was acknowledged and whose second was not: what is left, the second too."""
    from skein.operators.cursor import Delivery, Head, bind

    splits = _revisions(spark, sf)
    head = Head(splits.files)
    head.select(0, latest="a")
    bound = bind(head, splits, {"snapshot": "latest", "split": {"name": "third"}, "batch": 50})
    rows = D.numbered(_docs(spark, sf).join(splits.members(bound.snapshot, bound.revision, "third"), "sample_id", "left_semi").select("sample_id"), "sample_id")
    read = Delivery(rows, bound.plan, bound.token, 50)
    read.next()
    read.acknowledge()
    read.next()
    again = Delivery(rows, bound.plan, read.token, 50)
    return rows.filter(F.col("ordinal") >= again.cursor.ordinal).select(_id())


@query("ds_page_bytes", "SELECT id FROM (SELECT CAST(doc_id AS VARCHAR) AS id, sum(octet_length(encode(coalesce(text, '')))) OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS used FROM documents WHERE CAST(doc_id AS VARCHAR) > '4') WHERE used <= 50000 ORDER BY id LIMIT 500")
def _(spark, sf):
    """A page of at most 500 samples and 50,000 bytes of text."""
    return D.page(_docs(spark, sf), "sample_id", b"4", 500, F.octet_length(F.coalesce("text", F.lit(b""))), 50_000).select(_id())
