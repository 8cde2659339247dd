"""Every operator and stage on a table whose further columns have the names that operators use themselves."""

import pytest

from skein.llm import bloom_lm, decontamination, line_dedup, near_dedup, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, url_filter, warc
from skein.llm.queries import tokenizer

NAMES = ["_h", "_d", "_g", "_lines", "_file", "_pos", "h", "d", "key", "chunk", "n_words", "spans", "items", "node", "label", "score", "kept", "ids", "bucket"]
LINE = "a line of words that stands in two of the texts here"
TEXTS = ["\n".join([f"text {i} begins with words of its own, number {i * 7919}", LINE if i < 2 else f"nothing of text {i} is shared, not {i * 104729}", f"and it ends {i}"]) for i in range(4)]
TEXTS += [TEXTS[3], None, ""]
ORPHAN = "a text that has no id at all but words enough to be kept by every rule"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(TEXTS)]
    rows += [rows[2], (None, ORPHAN, None, None, None, *(None for _ in NAMES))]  # a repeated row, and one without an id
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, " ".join(TEXTS[2].split()[:12]))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def same(docs, out):
    """The rows of `out` are rows of docs in all columns but the text."""
    assert out.columns == docs.columns
    rest = [c for c in docs.columns if c != "text"]
    assert {tuple(r) for r in out.select(*(f"`{c}`" for c in rest)).collect()} <= {tuple(r) for r in docs.select(*(f"`{c}`" for c in rest)).collect()}


@pytest.mark.parametrize("k", range(4))
def test_stages(spark, docs, folder, k):
    import corpus_pipeline

    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    same(docs, out)
    rows = out.collect()
    left = {r.doc_id: r.text for r in rows}
    assert left[None] == ORPHAN and len(rows) == len(left) + (k != 2)  # near-dedup keeps one of the repeated rows
    assert [r.asDict() for r in corpus_pipeline.STAGES[4][1](spark, out, folder).orderBy("doc_id").collect()]
    if k == 0:
        assert left == {i: t for i, t in enumerate(TEXTS) if t} | {None: ORPHAN}
    if k == 1:
        assert LINE in left[0] and LINE not in left[1] and left[5] is None and left[6] == ""
    if k == 2:
        assert set(left) == {0, 1, 2, 3, 5, 6, None}
    if k == 3:
        assert left[2] != TEXTS[2] and all(left[i] == t for i, t in enumerate(TEXTS) if i != 2)


def test_operators(spark, docs, folder):
    plain = docs.select("doc_id", "text")
    rows = lambda df: sorted(map(repr, df.collect()))
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(7)], "doc_id long, quality int, toxic int, key string")
    pages = docs.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", docs.source)
    for f in (
        lambda t: sentencepiece_codec.digests(t, tokenizer()),
        lambda t: decontamination.digests(t, benchmark),
        line_dedup.digests,
        lambda t: quality_rules.judge(t.select("doc_id", "text")),
        lambda t: quality_classifier.classify(t, quality_classifier.fit(t, labels)).drop(*NAMES, "lang", "source", "n_chars"),
        suffix_dedup.digests,
        near_dedup.classes,
        bloom_lm.scores,
    ):
        assert rows(f(docs)) == rows(f(plain))
    for f in (url_filter.judge, warc.round_trip):
        assert rows(f(pages)) == rows(f(pages.select("page_id", "url", "html")))
    encoded = sentencepiece_codec.encode(docs, tokenizer())
    assert sentencepiece_codec.decode(encoded, tokenizer()).count() == len(TEXTS) + 2
