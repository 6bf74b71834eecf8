import hashlib
import random

import pytest

from duskveil.llm import common as C
from duskveil.llm import sentencepiece_backend as X

from . import cases

ODD = ["", " ", "  ", "a  b", "   a", "\n\n x", "é東京\U0001f600", " <s> </s> <unk> <0x0A>", "▁▁a ▁", "tab\there", "a\x00b", "word   \n   word", " " * 36 + "z", "\r\n", " " * 3000, "x" * 400, "for (  i = 0 ;   i<10;i++ )"]


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return X.Codec(X.model_path()), sentencepiece.SentencePieceProcessor(model_file=X.model_path())


def test_parity_and_decoding(both):
    codec, sp = both
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab  \n▁é.") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [" ".join(f"w{rng.randrange(9)}{'  ' * rng.randrange(2)}" for _ in range(80)) for _ in range(20)]
    flat, sizes = codec.encode([t.encode() for t in texts])
    ends = sizes.cumsum().tolist()
    ids = [flat[e - n : e].tolist() for e, n in zip(ends, sizes.tolist())]
    for t, x, back in zip(texts, ids, codec.decode(ids)):
        assert x == sp.encode(t), t
        assert back == sp.decode(x), t


def test_models_that_need_whole_texts(both):
    """A model whose normaliser or pieces reach across blanks takes texts whole, with the same ids."""
    codec = X.Codec(X.model_path())
    codec.by_segment = False
    texts = [t for t in ODD if "  " not in t and "▁▁" not in t]
    flat, sizes = codec.encode([t.encode() for t in texts])
    assert flat.tolist() == [k for t in texts for k in both[1].encode(t)] and sizes.tolist() == [len(both[1].encode(t)) for t in texts]


def test_model_file(both):
    m, sp = both[0].model, both[1]
    assert [p for p, _, _ in m.pieces] == [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
    assert (m.kind, m.byte_fallback, m.unk) == (X.BPE, True, sp.unk_id()) and m.separable()


def test_unigram_model_is_rebuilt():
    m = X.ModelFile(pieces=[("<unk>", 0.0, X.UNKNOWN), ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("a", -4.0, 1), ("b", -4.0, 1), ("abb", -3.5, 1)], kind=X.UNIGRAM)
    t = X.build(m)
    assert [e.ids for e in t.encode_batch(["▁ab", "▁abb", "▁abab"])] == [[2], [1, 5], [2, 3, 4]]
    assert X.normalizer(m).normalize_str("  a   b ") == "▁a▁b"
    m.pieces.append(("a▁b", -1.0, 1))
    assert not m.separable()


def test_op(spark, tmp_path, both):
    for k, data in enumerate((None, [])):
        got = X.op9_sentencepiece(spark, cases.write(spark, tmp_path / str(k), data)).collect()
        rows = cases.rows() if data is None else data
        want = sorted(repr((r[0], len(both[1].encode(r[1] or "")), hashlib.sha256(both[1].decode(both[1].encode(r[1] or "")).encode()).hexdigest())) for r in rows)
        assert sorted(repr((r["doc_id"], r["n_tokens"], r["decoded_sha256"])) for r in got) == want
        assert all(r["parity"] and r["round_trip"] for r in got)
    got = X.op9_sentencepiece(spark, cases.SF).collect()
    assert len(got) == C.table(spark, cases.SF, "documents").count() and all(r["parity"] and r["round_trip"] for r in got)
