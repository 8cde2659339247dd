import hashlib

import helpers as H
import test_decontamination as D
import test_line_dedup as L
import test_near_dedup as N
import test_quality_rules as Q

from skein.llm import decontamination, line_dedup
from skein.llm.queries import tokenizer


def test_stages_against_plain(spark, tmp_path):
    import corpus_pipeline as P
    import sentencepiece

    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    rows = list(enumerate(H.texts(n=50)))
    item = next(t for _, t in rows if t and len(t.split()) > 60)
    item = " ".join(item.split()[20:45])
    at = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = [(d, t) for d, t in rows if Q.plain(t)[-1]]
    docs = [(d, x[2]) for d, x in L.plain(docs, line_dedup.MIN_CHARS).items() if H.solid(x[2])]
    classes = N.plain(docs)
    docs = [(d, t) for d, t in docs if classes[d] == d]
    windows = decontamination.Windows([("1", item.encode())], 10)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    want = []
    for d, t in docs:
        _, hits = decontamination.find([t.encode()], windows)
        t = decontamination.cut(t.encode(), hits[0][0]).decode() if 0 in hits else t
        assert D.plain([(d, t)], [(1, item)])[0][2] == 0
        ids = library.encode(t)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = [tuple(r)[:3] for r in P.run(spark, at).collect()]
    assert sorted(got) == sorted(want) and len(got) < len(rows)
    columns = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, columns, at).columns == columns.columns
        assert stage(spark, columns.filter("false"), at).count() == 0


def test_one_of_a_large_group_of_variants_stays(spark, tmp_path):
    import corpus_pipeline as P

    texts = N.variants(220, seed=6)
    df = spark.createDataFrame([((7 * d) % 221, t, "en", "s", len(t)) for d, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [x.doc_id for x in P.near_duplicates(spark, df, str(tmp_path)).collect()] == [0]
