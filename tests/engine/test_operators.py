import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import transforms as X
from skein.operators import kv as K
from skein.operators import metrics as M
from skein.operators import table as T
from skein.sources import avro, vectors


def histogram(spark, values):
    return M.histogram(spark.createDataFrame([(v,) for v in values], "v long"), F.col("v"))


def test_quantiles(spark):
    r = M.quantiles(histogram(spark, range(1, 1001))).first()
    assert (r["count"], r["sum"], r["min"], r["max"]) == (1000, 500500, 1, 1000)
    assert [int(r[q]) for q in M.QUANTILES] == [501, 903, 951, 991, 999]
    assert int(M.quantiles(histogram(spark, [123])).first().p50) == 123
    both = M.merge(histogram(spark, [100]).union(histogram(spark, [900])))
    r = M.quantiles(both).first()
    assert (r["count"], r["sum"], r["min"], r["max"]) == (2, 1000, 100, 900)
    assert int(M.quantiles(histogram(spark, [2**40])).first().p50) == 2**64 - 1


def test_buckets(spark):
    values = [0, 255, 256, 257, 511, 512, 1023, 2**20 + 5, 2**40 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", M.bucket(F.col("v")).alias("b")).withColumn("u", M.upper(F.col("b"))).collect()
    for r in rows:
        step = max(0, r.v.bit_length() - 8)
        assert r.u == (r.v if r.v < 256 else ((r.v >> step) + 1 << step) - 1)


def test_seek(spark):
    keys = spark.createDataFrame([(bytearray(k),) for k in (b"b", b"d", b"f")], "key binary")
    probes = spark.createDataFrame([(bytearray(p),) for p in (b"a", b"b", b"c", b"g")], "probe binary")
    got = {bytes(r.probe): tuple(None if x is None else bytes(x) for x in tuple(r)[1:]) for r in K.seek(keys, probes).collect()}
    assert got == {b"a": (b"b", b"b", None, None), b"b": (b"b", b"d", b"b", None), b"c": (b"d", b"d", b"b", b"b"), b"g": (None, None, b"f", b"f")}


def test_seek_of_many_probes(spark):
    keys = spark.range(0, 3000, 3).selectExpr("encode(lpad(id, 5, '0'), 'utf-8') AS key")
    probes = spark.range(0, 3000, 2).selectExpr("encode(lpad(id, 5, '0'), 'utf-8') AS probe").union(spark.sql("SELECT CAST(NULL AS BINARY)"))
    out = K.seek(keys, probes)
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()  # such a frame takes the square of a range
    got = {r.probe and int(r.probe): tuple(x and int(x) for x in tuple(r)[1:]) for r in out.collect()}
    want = {p: (-(-p // 3) * 3, p // 3 * 3 + 3, p // 3 * 3, -(-p // 3) * 3 - 3) for p in range(0, 3000, 2)}
    want = {p: tuple(x if 0 <= x < 3000 else None for x in v) for p, v in want.items()}
    assert got == want | {None: (None,) * 4}


def test_byte_page_and_gap(spark):
    items = spark.createDataFrame([(bytearray(b"a"), 10), (bytearray(b"b"), 5)], "key binary, n int")
    assert K.byte_page(items, F.col("n"), 9, 10).count() == 0 and K.byte_page(items, F.col("n"), 10, 10).count() == 1
    journal = spark.createDataFrame([(5, "k")], "slot long, key string")
    with pytest.raises(K.Gap):
        K.replay_from(journal, 3)


def vector(spark, ranges):
    return spark.createDataFrame([("f", a, b) for a, b in ranges], "file_path string, start long, end long")


def test_vectors(spark):
    old = vector(spark, [(10, 20)])
    covers = lambda *r: T.uncovered(old, vector(spark, r)).isEmpty()
    assert covers((9, 21)) and not covers((10, 19)) and not covers((11, 20)) and not covers((10, 13), (14, 20))
    pos = spark.createDataFrame([("f", 2**32 - 1), ("f", 2**32)], "file_path string, pos long")
    assert [(r.start, r.end) for r in T.coalesced(pos).collect()] == [(2**32 - 1, 2**32 + 1)]


def test_vector_contains_without_pairs(spark):
    ranges = vector(spark, [(3, 5), (4, 9), (T.BLOCK - 1, 3 * T.BLOCK + 1), (7, 7), (8, 2)])
    probes = spark.createDataFrame([("f", p) for p in (2, 3, 8, 8, 9, T.BLOCK - 2, T.BLOCK - 1, 2 * T.BLOCK, 3 * T.BLOCK, 3 * T.BLOCK + 1)] + [("g", 3), (None, 3), ("f", None), ("f", None)], "file_path string, pos long")
    out = T.contains(probes, ranges)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()  # a block's positions were paired with all its ranges
    got = sorted(((r.file_path or "", -1 if r.pos is None else r.pos, r.deleted) for r in out.collect()))
    yes = {3, 8, T.BLOCK - 1, 2 * T.BLOCK, 3 * T.BLOCK}
    assert got == [("", 3, False)] + [("f", p, p in yes) for p in (-1, 2, 3, 8, 9, T.BLOCK - 2, T.BLOCK - 1, 2 * T.BLOCK, 3 * T.BLOCK, 3 * T.BLOCK + 1)] + [("g", 3, False)]


def test_vector_deletes_without_pairs(spark):
    rows = spark.createDataFrame([("f", p, f"{p}") for p in (0, 1, T.BLOCK, T.BLOCK, T.BLOCK + 5)] + [(None, 1, "n")], "file_path string, pos long, x string")
    out = T.vector_deleted(rows, vector(spark, [(1, 2), (T.BLOCK + 2, T.BLOCK + 9)]))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString() and out.columns == rows.columns
    assert sorted(r.x for r in out.collect()) == ["0", f"{T.BLOCK}", f"{T.BLOCK}", "n"]


def test_vectors_compare_by_ranges(spark):
    n = 1 << 33  # more positions than an array can have
    old, new = vector(spark, [(0, n)]), vector(spark, [(0, 10), (8, n - 2), (n - 1, n + 5)])
    assert [(r.file_path, r.pos) for r in T.uncovered(old, new).collect()] == [("f", n - 2)]


def test_surviving_vectors_compare_by_ranges(spark):
    n = 1 << 33
    old, new = vector(spark, [(0, n)]).union(spark.sql("SELECT 'gone', 0L, 9L")), vector(spark, [(1, n)])
    kept = spark.createDataFrame([("f",), ("f",), (None,)], "file_path string")
    assert [(r.file_path, r.pos) for r in T.uncovered(old, new, kept).collect()] == [("f", 0)]


def test_a_file_coalesces_in_parts(spark):
    b = T.BLOCK
    pos = spark.range(0, 12 * b, 2).selectExpr("'f' AS file_path", "id AS pos").union(spark.range(2 * b - 1, 5 * b + 1).selectExpr("'f'", "id"))
    out = T.coalesced(pos)
    assert out.select(F.spark_partition_id()).distinct().count() > 2  # no task has a whole file
    got = sorted((r.start, r.end) for r in out.collect())
    assert got == [(p, p + 1) for p in range(0, 2 * b - 2, 2)] + [(2 * b - 2, 2 * b - 1 + 3 * b + 2)] + [(p, p + 1) for p in range(5 * b + 2, 12 * b, 2)]


def test_vector_blobs():
    r = np.random.default_rng(1)
    for p in (np.zeros(0, np.int64), np.array([0, 5, 2**32, 2**40 + 7]), r.integers(0, 200_000, 60_000), np.arange(70_000)):
        assert (vectors.decode(vectors.encode(p)) == np.unique(p)).all()
    blob = bytearray(vectors.encode(np.arange(10)))
    blob[-1] ^= 1
    with pytest.raises(vectors.Broken):
        vectors.decode(bytes(blob))


def test_avro():
    fields = [("a", "long"), ("b", "string"), ("c", "double"), ("d", "boolean"), ("e", "bytes")]
    r = random.Random(2)
    rows = [{"a": r.choice([None, r.randint(-(2**62), 2**62)]), "b": r.choice([None, "é" * r.randint(0, 9)]), "c": r.random(), "d": r.random() < 0.5, "e": bytes(range(r.randint(0, 5)))} for _ in range(50)]
    for deflate in (True, False):
        data = avro.container(rows, fields, deflate)
        assert list(avro.records(data)) == rows
        with pytest.raises(avro.Broken):
            list(avro.records(data[:-3]))


def test_partition_keys(spark):
    rows = spark.createDataFrame([(1, 0.0, -0.0), (2, float("nan"), float("nan")), (3, None, None), (4, 1.0, 1.0)], "i int, a double, b double")
    got = {r.i: r.same for r in rows.select("i", (T.partition_key({"a": "double"}) == T.partition_key({"b": "double"})).alias("same")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}


def test_promotion():
    assert X.promotes("int", "long") and X.promotes("decimal(5,2)", "decimal(9,2)") and X.promotes("date", "timestamp", 3)
    assert not X.promotes("long", "int") and not X.promotes("decimal(5,2)", "decimal(9,3)") and not X.promotes("date", "timestamp", 2)
    with pytest.raises(ValueError):
        X.result_type("hour", "date")
