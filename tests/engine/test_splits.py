import json

import pytest
from pyspark.sql import functions as F

from skein.functions import encodings as E
from skein.operators import dataset as D
from skein.operators.catalog import Conflict, Files
from skein.operators.cursor import Delivery, Head, ReadCursor, Refused, bind, strict_json
from skein.operators.splits import Inherited, Splits
from skein.sources import avro, manifests


@pytest.fixture
def samples(spark):
    return spark.range(40).select(F.format_string("s%03d", "id").cast("binary").alias("sample_id"), "id")


def test_revisions(spark, tmp_path, samples):
    s = Splits(Files(spark, f"file://{tmp_path}"))
    first = s.prepare("a", samples, {"low": F.col("id") < 20, "even": F.col("id") % 2 == 0}, overlap_allowed=True)
    assert first["splits"] == {"low": 20, "even": 20} and (first["unassigned"], first["overlapping"]) == (10, 10)
    with pytest.raises(D.Rejected):
        s.prepare("a", samples, {"low": F.col("id") < 20, "even": F.col("id") % 2 == 0})
    with pytest.raises(D.Rejected):
        s.prepare("a", samples, {"low": F.col("id") < 20}, unassigned_allowed=False)
    assert s.revisions("a") == [1]
    assert s.select("a", 1, 0) == s.select("a", 1, 7) == {"revision": 1, "generation": 1}
    s.prepare("a", samples, {"all": F.lit(True)})
    with pytest.raises(Conflict):
        s.select("a", 2, 0)
    page = s.members("a", 1, "low", after=b"s004", limit=3).collect()
    assert [bytes(r.sample_id) for r in page] == [b"s005", b"s006", b"s007"]
    kept = s.prepare("b", samples.filter("id > 4"), {"old": Inherited("a", 1, "low")}, parent="a")
    assert kept["splits"] == {"old": 15}
    for rule in (Inherited("a", 1, "low"), Inherited("x", 1, "low"), Inherited("b", 1, "low")):
        with pytest.raises(D.Rejected):
            s.prepare("c", samples, {"old": rule}, parent="b")


def test_bound_read_comes_again_until_it_is_acknowledged(spark, tmp_path, samples):
    files = Files(spark, f"file://{tmp_path}")
    s, head = Splits(files), Head(files)
    s.prepare("a", samples, {"even": F.col("id") % 2 == 0})
    s.select("a", 1, 0)
    with pytest.raises(Refused):
        bind(head, s, {"snapshot": "latest"})
    head.select(0, latest="a")
    bound = bind(head, s, {"snapshot": "latest", "split": {"name": "even"}})
    s.prepare("a", samples, {"even": F.col("id") < 3})
    s.select("a", 2, 1)
    assert (bound.snapshot, bound.revision) == ("a", 1)
    with pytest.raises(Refused):
        bind(head, s, {"snapshot": "a", "split": {"name": "odd"}})
    rows = D.numbered(s.members("a", bound.revision, "even"), "sample_id")
    read, seen = Delivery(rows, bound.plan, bound.token, 8), []
    while batch := read.next():
        again = Delivery(rows, bound.plan, read.token, 8).next()
        assert batch == read.next() == again
        seen += [r.ordinal for r in batch]
        read.acknowledge()
    assert seen == list(range(20))
    with pytest.raises(Refused):
        Delivery(rows, bound.plan | {"snapshot": "other"}, read.token, 8)


def test_first_cursor():
    plan = {"shuffle": 1}
    c = ReadCursor.start(plan, "s")
    assert c.confirmed(plan, "s", 3, 4) == ReadCursor(c.plan, "s", 3, 4)
    for other in (({"shuffle": 2}, "s"), (plan, "t")):
        with pytest.raises(Refused):
            c.confirmed(*other, 1, 1)


def test_json_is_bounded_in_bytes():
    assert strict_json('{"a": "é"}', 11) == {"a": "é"}
    for text in ('{"a": "éé"}', '{"a":1,"a":2}'):
        with pytest.raises(Refused):
            strict_json(text, 12)


def test_escapes_keep_the_order(spark):
    import itertools

    keys = [bytes(k) for n in range(4) for k in itertools.product((0, 1, 255), repeat=n)]
    got = {bytes(r.k): bytes(r.e) for r in spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select("k", E.escaped(F.col("k")).alias("e")).collect()}
    assert sorted(keys) == sorted(keys, key=got.__getitem__)
    assert len({a + b for a in got.values() for b in got.values()}) == len(got) ** 2


def test_decimals(spark):
    values = [0, 1, -1, 127, -128, 10**18, -(10**18) - 5, 2**63, -(2**63), 10**37 + 7, 10**38 - 1, -(10**38) + 1]
    rows = []
    for v in values:
        n = (v.bit_length() + 8) // 8
        rows += [(str(v), bytearray(v.to_bytes(k, "big", signed=True))) for k in (n, n + 1, 16, 20) if k >= n]
    df = spark.createDataFrame(rows, "v string, b binary").withColumn("got", E.unscaled(F.col("b"), 38))
    assert all(int(r.got) == int(r.v) for r in df.collect())
    bad = spark.createDataFrame([(bytearray(b""),), (bytearray((10**5).to_bytes(4, "big")),), (bytearray((2**127).to_bytes(17, "big")),)], "b binary")
    assert {r.got for r in bad.select(E.unscaled(F.col("b"), 5).alias("got")).collect()} == {None}


def test_avro_of_nested_records_by_field_ids():
    rows = [{"status": 1, "snapshot_id": None, "sequence_number": 4, "file_sequence_number": 4, "data_file": {"content": 0, "file_path": "f", "file_format": "parquet", "partition": {"partition": "p"}, "record_count": 7, "file_size_in_bytes": 8, "value_counts": [{"key": 1, "value": 7}], "lower_bounds": [{"key": 1, "value": b"a"}], "equality_ids": []}}] * 2500
    data = avro.file(rows, manifests.ENTRY, {"x": "y"})
    got = list(avro.records(data))
    schema = json.loads(avro.head(data)["avro.schema"])
    assert len(got) == 2500 and avro.head(data)["x"] == "y" and got[7]["data_file"]["value_counts"] == [{"key": 1, "value": 7}]
    for path, value in (((2, 103), 7), ((2, 102, 1000), "p"), ((1,), None), ((2, 999), None), ((1, 5), None)):
        assert avro.project(got[0], schema, path) == value
    for cut in (10, len(data) // 2, len(data) - 3):
        with pytest.raises((avro.Broken, Exception)):
            list(avro.records(data[:cut]))


def test_signed_cursors():
    from skein.operators.cursor import Cursor, plan_identity

    plan = {"a": 1}
    c = Cursor(plan_identity(plan), "s", ordinal=5)
    assert Cursor.parse(c.token(b"key"), plan, b"key") == c == Cursor.parse(c.token(), plan)
    for token, secret in ((c.token(), b"key"), (c.token(b"other"), b"key"), ("", b"key"), ("!", None)):
        with pytest.raises(Refused):
            Cursor.parse(token, plan, secret)


def test_a_hole_in_the_journal_is_an_error_frame(spark, tmp_path):
    from skein.streaming import journal as J

    at = f"file://{tmp_path}/journal"
    ops = spark.range(10, 20).select(F.col("id").alias("slot"), F.lit("k").cast("binary").alias("key"))
    ops.write.parquet(at)
    seen, frames = [], []
    w = J.Watches(J.source(spark, at, ops.schema), expected=5)
    w.subscribe("g", b"k", lambda batch, _: seen.append(batch.count()), lambda *slots: frames.append(slots))
    w.subscribe("g", b"x", lambda batch, _: seen.append(-batch.count()))
    w.start(f"file://{tmp_path}/offsets").awaitTermination()
    assert (seen, frames, w.expected) == ([10, 0], [(5, 10)], 20)
    assert w.unsubscribe("g", b"x") and not w.unsubscribe("g", b"x")
    ops.select(F.col("slot") + 10, "key").toDF("slot", "key").write.mode("append").parquet(at)
    w.start(f"file://{tmp_path}/offsets").awaitTermination()
    assert (seen, frames, w.expected) == ([10, 0, 10], [(5, 10)], 30)
