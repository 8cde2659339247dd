import pytest
from pyspark.sql import functions as F

from skein.functions.predicates import ALL, And, Explicit, FieldMatch, InvalidPredicate, Keyword, Not, Or, Prefix, Range, compile, successor, validate
from skein.operators import dataset as D


@pytest.fixture(scope="module")
def samples(spark):
    """Effective values: a inline `old`, b inline empty, c a chunk, d missing, e deleted in the child snapshot."""
    members = spark.createDataFrame([("child", bytearray(x)) for x in (b"a", b"b", b"c", b"d", b"e")], "snapshot string, sample_id binary")
    rows = [("base", b"a", "value", "inline", b"old"), ("base", b"b", "value", "inline", b""), ("base", b"c", "value", "chunk", None), ("base", b"e", "value", "inline", b"old"), ("child", b"e", "value", "tombstone", None)]
    fields = spark.createDataFrame([(s, bytearray(i), f, k, None if v is None else bytearray(v)) for s, i, f, k, v in rows], "snapshot string, sample_id binary, field string, kind string, value binary")
    chain = D.ancestors(spark.createDataFrame([("base", None), ("child", "base")], "id string, parent string"), "child")
    overlay = D.effective(members, fields, chain)
    values = overlay.groupBy("sample_id").agg(D.visible("value", overlay))
    return members.select("sample_id").join(values, "sample_id", "left")


@pytest.mark.parametrize(
    ("predicate", "ids"),
    [
        (FieldMatch("value", b"old"), "a"),
        (FieldMatch("value", b""), "b"),
        (Keyword(b"old"), "a"),
        (Not(FieldMatch("value", b"old")), "bcde"),
        (Range(b"b", b"e") & Not(Explicit((b"c",))), "bd"),
        (Explicit(()), ""),
        (ALL, "abcde"),
        (Prefix(b"a") | Explicit((b"e",)), "ae"),
    ],
)
def test_selection(samples, predicate, ids):
    got = D.select(samples, predicate, ["value"]).collect()
    assert "".join(sorted(bytes(r.sample_id).decode() for r in got)) == ids


def test_rejections(samples):
    with pytest.raises(InvalidPredicate):
        D.select(samples, FieldMatch("unknown", b""), ["value"])
    with pytest.raises(D.Rejected):
        D.existing(samples, Explicit((b"absent",)))
    D.existing(samples, Explicit((b"a", b"e")))
    deep = FieldMatch("value", b"x")
    for _ in range(40):
        deep = Not(deep)
    for bad, version in ((Prefix(b""), 2), (Range(b"", b"a"), 2), (Range(b"b", b"b"), 2), (And(()), 2), (Or(()), 2), (Keyword(b""), 2), (FieldMatch("value", b""), 1), (Explicit((b"a", b"a")), 1), (deep, 2), (Explicit(tuple(str(i).encode() for i in range(10_001))), 2)):
        with pytest.raises(InvalidPredicate):
            validate(bad, {"value"}, version)


def test_never_null(samples):
    for p in (FieldMatch("value", b"x"), Keyword(b"x"), Prefix(b"x")):
        got = samples.select(compile(p, F.lit(None).cast("binary"), {"value": F.lit(None).cast("binary")}).alias("p")).first()
        assert got.p is False


def test_successor():
    assert successor(b"ab") == b"ac" and successor(b"a\xff\xff") == b"b" and successor(b"\xff") is None
