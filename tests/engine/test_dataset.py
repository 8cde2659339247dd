import hashlib

import pytest
from pyspark.sql import functions as F

from skein.functions import hashing
from skein.operators import dataset as D


def ids(spark, names):
    return spark.createDataFrame([(bytearray(n),) for n in names], "sample_id binary")


def bucket(seed, name, total, tag=hashing.SPLIT_DOMAIN):
    h = hashlib.sha256(tag + seed.to_bytes(8, "big") + len(name).to_bytes(4, "big") + name).digest()
    return int.from_bytes(h[:8], "big") * total >> 64


def test_split_buckets(spark):
    names = [b"a", b"\x00\xff\x00", b"sample-42", "é".encode(), b"x" * 300]
    for seed in (0, 1, 2**64 - 1):
        for total in (100, 2**32 - 1):
            for tag in (hashing.SPLIT_DOMAIN, b"another\0"):
                got = ids(spark, names).select("sample_id", hashing.split_bucket(F.col("sample_id"), seed, total, tag).alias("b")).collect()
                assert {bytes(r.sample_id): r.b for r in got} == {n: bucket(seed, n, total, tag) for n in names}


def test_weights(spark):
    df = ids(spark, [str(i).encode() for i in range(300)])
    weights = [("train", 80), ("validation", 10), ("test", 10)]
    got = {bytes(r.sample_id): r.s for r in df.select("sample_id", D.weighted_split(F.col("sample_id"), weights, 3).alias("s")).collect()}
    for n, s in got.items():
        b = bucket(3, n, 100)
        assert s == ("train" if b < 80 else "validation" if b < 90 else "test")
    for bad in ([], [("a", 0)], [("a", 1), ("a", 1)], [("a", 2**32)]):
        with pytest.raises(D.Rejected):
            D.weighted_split(F.col("sample_id"), bad, 0)


def test_split_report(spark):
    names = [f"s{i:02}".encode() for i in range(61)]
    members = spark.createDataFrame([("x", bytearray(names[0]))] + [(s, bytearray(n)) for n in names[31:] for s in "xy"], "split string, sample_id binary")
    report = D.split_report(ids(spark, names), members)
    r = report.first()
    assert (r.scanned, r.assigned, r.unassigned, r.overlapping) == (61, 31, 30, 30)
    assert len(r.unassigned_ids) == len(r.overlapping_ids) == 20 and bytes(r.unassigned_ids[0]) == b"s01"
    ok = report.select(D.satisfied(report), D.satisfied(report, overlap_allowed=True), D.satisfied(report, overlap_allowed=True, unassigned_allowed=False)).first()
    assert tuple(ok) == (False, True, False)


def test_order_and_shards(spark):
    names = [b"s" + bytes([n]) + b"\xff" for n in range(15, -1, -1)]
    got = {r.ordinal: bytes(r.sample_id) for r in D.numbered(ids(spark, names), "sample_id").collect()}
    assert [got[i] for i in range(16)] == sorted(names)
    numbered = D.numbered(ids(spark, names), "sample_id")
    parts = [sorted(r.ordinal for r in D.shard(numbered, rank, 2, worker, 2).collect()) for rank in range(2) for worker in range(2)]
    assert sorted(sum(parts, [])) == list(range(16)) and parts[3] == [3, 7, 11, 15]
    snapshot = bytes(range(16))
    shuffled = {r.ordinal: bytes(r.sample_id) for r in D.group_shuffle(ids(spark, names), 9, snapshot, 5).collect()}
    want = []
    for k in range(0, 16, 5):
        want += sorted(sorted(names)[k : k + 5], key=lambda n: (hashlib.md5((9).to_bytes(8, "little") + snapshot + n).digest(), n))
    assert [shuffled[i] for i in range(16)] == want
    assert D.admitted(ids(spark, names), F.octet_length("sample_id"), max_samples=16, max_bytes=48, max_batches=6, batch=3)["batches"] == 6
    for limits in ((15, 48, 6), (16, 47, 6), (16, 48, 5)):
        with pytest.raises(D.Rejected):
            D.admitted(ids(spark, names), F.octet_length("sample_id"), max_samples=limits[0], max_bytes=limits[1], max_batches=limits[2], batch=3)


def test_delivery_and_chain(spark):
    rows = list(D.delivered(spark.range(7).coalesce(1), 3))
    assert [len(r) for r, _ in rows] == [3, 3, 1] and [n for _, n in rows] == [3, 6, 7]
    with pytest.raises(D.Rejected):
        D.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"), "a")


def test_compose_rejects(spark):
    df = spark.createDataFrame([(bytearray(b"a"), "x")], "sample_id binary, f string")
    with pytest.raises(D.Rejected):
        D.compose(df, df, df.union(df), df.select("sample_id").filter("false"), ["f"])
    with pytest.raises(D.Rejected):
        D.compose(df, df, df, df.select("sample_id"), ["f"])


def test_slot(spark):
    import xxhash

    got = ids(spark, [b"a", b"bc"]).select("sample_id", hashing.slot(F.col("sample_id"), 64).alias("s")).collect()
    assert all(r.s == xxhash.xxh64_intdigest(bytes(r.sample_id)) % 64 for r in got)
