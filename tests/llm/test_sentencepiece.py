import hashlib
import random

import helpers as H
import pytest

from skein.llm import sentencepiece_codec as S
from skein.llm.queries import tokenizer

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    path = tokenizer()
    return S.Codec(S.load(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def test_as_the_library(both):
    codec, library = both
    r = random.Random(2)
    odd = "aetn  ▁\n\t<0x>éß日本🙂\x00thein.,"
    for t in [x or "" for x in H.texts()] + ["".join(r.choice(odd) for _ in range(r.randint(0, 50))) for _ in range(1500)] + [" " * k + "x" + " " * k for k in range(20)]:
        ids = library.encode(t)
        assert codec.encode(t) == ids
        joined, n, text = codec.round_trip(t)
        assert (joined, n, text) == (",".join(map(str, ids)), len(ids), library.decode(ids))
        assert codec.decode(ids) == library.decode(ids)


def test_decode_of_any_ids(both):
    codec, library = both
    r = random.Random(3)
    for _ in range(1500):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids)


def test_bounded_caches(both):
    codec, library = both
    was = S.Codec.WORDS, S.Codec.PAIRS
    try:
        S.Codec.WORDS = S.Codec.PAIRS = 3
        for t in H.texts()[:20]:
            assert codec.encode(t or "") == library.encode(t or "")
            assert codec.round_trip(t or "")[2] == library.decode(library.encode(t or ""))
    finally:
        S.Codec.WORDS, S.Codec.PAIRS = was


def test_full_caches_are_small(both):
    """What a part takes, times the bounds: a worker keeps less than 75 MB."""
    import tracemalloc

    r = random.Random(4)
    words = ["".join(r.choice("etaoinèé") for _ in range(r.randint(4, 12))) for _ in range(6000)]
    codec = S.Codec(both[0].model)
    n = len(words)
    tracemalloc.start()
    try:
        for k in range(0, n, 100):
            codec.round_trip(" ".join(words[k : k + 100]))
        used = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert n <= len(codec.words)
    assert used / len(codec.words) * 2 * S.Codec.WORDS < 75e6


def test_parts_that_decode_to_other_text(both):
    """Without byte pieces an unknown character's text is another one."""
    model = both[0].model
    none = S.Codec(model | {"pieces": [(p, s, S.UNUSED if t == S.BYTE else t) for p, s, t in model["pieces"]]})
    long = "the" * 90 + "日"
    for t in ["of 日本 the", "日", f"a {long} b", "𝄞 and the\n日\n", "x  日  y"] * 2:
        ids = none.encode(t)
        assert none.round_trip(t) == (",".join(map(str, ids)), len(ids), none.decode(ids))


def test_tables(spark, both):
    library = both[1]
    df = H.docs(spark)
    got = S.digests(df, tokenizer()).collect()
    assert len(got) == df.count()
    want = {}
    for r in df.collect():
        ids = library.encode(r.text or "")
        want.setdefault(r.doc_id, []).append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id]
    back = S.decode(S.encode(df, tokenizer()), tokenizer()).collect()
    assert sorted(r.text for r in back) == sorted(library.decode(library.encode(r.text or "")) for r in df.collect())
    assert S.digests(H.empty(spark), tokenizer()).count() == 0
