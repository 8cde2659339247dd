import numpy as np
import pytest

from skein.operators.catalog import Conflict, Files
from skein.operators.cursor import Cursor, Head, Refused, plan_identity, strict_json
from skein.sources import files, puffin, vectors
from skein.sources.evolution import Field, schema


def test_puffin(spark, tmp_path):
    p = np.array([1, 5, 9])
    data = puffin.file([({"type": "deletion-vector-v1", "fields": [], "properties": {"referenced-data-file": "f", "cardinality": "3"}}, vectors.encode(p))])
    (tmp_path / "a.puffin").write_bytes(data)
    r = puffin.blobs(spark, f"file://{tmp_path}").first()
    assert (r.type, r.data_file, r.cardinality) == ("deletion-vector-v1", "f", 3) and (vectors.decode(bytes(r.blob)) == p).all()
    assert files.kinds(spark, f"file://{tmp_path}", "*.puffin").first().kind == "puffin"
    for bad in (data[:-1], b"PFA1", data[:-12] + b"\xff\0\0\0" + data[-8:]):
        with pytest.raises(puffin.Broken):
            puffin.footer(bad)


def test_cursor():
    plan = {"predicate": "all", "batch": 3}
    c = Cursor(plan_identity(plan), "s")
    assert Cursor.parse(c.token(), plan) == c
    assert c.moved(3, 5, "z").offset == 3 and c.moved(3, 5, "z").moved(2, 5, "z") == Cursor(c.plan, "s", "z", 5, 0)
    for token, p in ((c.token(), {"batch": 4}), ("!!", plan), (c.token()[:-4], plan)):
        with pytest.raises(Refused):
            Cursor.parse(token, p)
    assert strict_json('{"a": {"b": 1}}') == {"a": {"b": 1}}
    with pytest.raises(Refused):
        strict_json('{"a": 1, "a": 2}')


def test_head(spark, tmp_path):
    h = Head(Files(spark, f"file://{tmp_path}/d"))
    assert h.read()["generation"] == 0
    one = h.select(0, latest="x")
    assert one["generation"] == 1 and h.select(0, latest="x") == one
    with pytest.raises(Conflict):
        h.select(0, latest="y")
    assert h.select(1, stable="x") == {"latest": "x", "stable": "x", "generation": 2}


def test_field_ids(spark, tmp_path):
    at = f"file://{tmp_path}/p"
    spark.createDataFrame([(1, "a")], schema([Field(1, "old", "long"), Field(2, "s", "string")])).write.parquet(at)
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    try:
        r = spark.read.schema(schema([Field(1, "new", "long"), Field(9, "extra", "string"), Field(2, "s", "string")])).parquet(at).first()
    finally:
        spark.conf.unset("spark.sql.parquet.fieldId.read.enabled")
    assert (r.new, r.extra, r.s) == (1, None, "a")


def test_avro_round_trip_writes_every_order(spark, tmp_path, monkeypatch):
    from skein import registry
    from skein.sources import avro

    spark.range(1, 301).selectExpr("id AS o_orderkey", "'O' AS o_orderstatus", "id / 2D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    written, write = [], avro.write
    monkeypatch.setattr(avro, "write", lambda df, at: (written.append(df.count()), write(df, at)))
    got = registry.queries()["src_avro_round_trip"](spark, str(tmp_path)).collect()
    assert written == [300] and sorted(r.o_orderkey for r in got) == list(range(1, 301))


def test_avro_holds_a_block(monkeypatch):
    import io

    from skein.sources import avro

    made = []
    rows = ({"a": made.append(k) or k, "b": None if k % 2 else "x" * (k % 9)} for k in range(30_000))
    parts, pending = [], []
    for part in avro.pieces(rows, [("a", "long"), ("b", "string")]):
        parts.append(part)
        pending.append(len(made))
    assert max(b - a for a, b in zip(pending, pending[1:], strict=False)) <= avro.ROWS  # rows are asked for as blocks are written
    got = list(avro.blocks(io.BytesIO(b"".join(parts))))
    assert max(map(len, got)) <= avro.ROWS and [r for b in got for r in b] == [{"a": k, "b": None if k % 2 else "x" * (k % 9)} for k in range(30_000)]
    monkeypatch.setattr(avro, "ROWS", 1 << 20)
    one = avro.container([{"a": k} for k in range(9000)], [("a", "long")])
    monkeypatch.undo()
    assert [len(b) for b in avro.blocks(io.BytesIO(one))] == [4096, 4096, 808]
