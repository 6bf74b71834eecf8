import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from duskveil.llm import common as C
from duskveil.llm import token_ids as X

from . import cases


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=60))
def test_ranks_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = X.encode_ranks(ranks)
    assert len(control) == -(-len(values) // 4)
    assert (X.decode_ranks(control, data, len(values)) == ranks).all()


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(X.tokenizer_path("word_bpe_49k.json"))
    return {(d, x): t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in rows}


def check(got, rows):
    want = brute(rows)
    left = sorted((r for r in got), key=lambda r: r["start"])
    start = 0
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in left] == sorted(-1 if d is None else d for d, _ in rows)
    for r in left:
        assert r["start"] == start
        start += r["n_tokens"]
    digest = lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((repr(d), *digest(want[d, x])) for d, x in rows)


def test_cases(spark, tmp_path):
    sf = cases.write(spark, tmp_path)
    check(X.op1_token_ids(spark, sf).collect(), [r[:2] for r in cases.rows()])
    sf = cases.write(spark, tmp_path / "none", [])
    assert X.op1_token_ids(spark, sf).count() == 0


def test_documents_and_ids(spark):
    rows = [(r["doc_id"], r["text"]) for r in C.table(spark, cases.SF, "documents").collect()]
    check(X.op1_token_ids(spark, cases.SF).collect(), rows)
    to = C.new_path(spark, "t")
    X.write_token_files(C.table(spark, cases.SF, "documents"), X.tokenizer_path("word_bpe_49k.json"), to, end_id=1, shards=5)
    want = brute(rows)
    by = dict(rows)
    got = X.read_token_files(spark, to).collect()
    assert len(got) == len(rows)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"], by[r["doc_id"]]] for r in got)


def test_other_tokenizer_takes_whole_texts():
    path = X.tokenizer_path("byte_bpe_50k.json")
    assert not X.splits_at_space(path) and X.splits_at_space(X.tokenizer_path("word_bpe_49k.json"))
    enc = X.Encoder(path)
    ids, sizes = enc.encode([b"two words  here", b"", b"x"], 7)
    assert enc.tokenizer.decode(ids[: sizes[0] - 1].tolist()) == "two words  here" and ids[sizes[0] - 1] == 7 and sizes.tolist()[1:] == [1, 2]


def test_pieces_are_encoded_as_whole_texts_are():
    enc = X.Encoder(X.tokenizer_path("word_bpe_49k.json"))
    texts = ["Don't stop, WON'T. we're A.B.C., x.", "É, é. É Straße ÄÖ, ª º µ. ", "a,b a, ,a .,. ... 12. 3,4 x1, ", "İstanbul ΣΑΣ, ς. e\u0301 e\u0301, \u0301", "<|endoftext|> a<|startoftext|>b,", "東京, 東京。\u00a0a\u2003b\u200bc\x00d\x1fe \x85f"]
    texts += ["", " ", "a***b", "***", "naïve--- 'tis rock'n'roll,' it's' x's'", "tab\tvt\x0bff\x0cnel\u0085ls\u2028ps\u2029ogham\u1680thin\u2009wide\u3000end"]
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for k, t in enumerate(texts):
        assert enc.encode([t.encode()])[0].tolist() == want[k], t
    ids, sizes = enc.encode([t.encode() for t in texts], 1)
    assert ids.tolist() == [x for w in want for x in [*w, 1]] and sizes.tolist() == [len(w) + 1 for w in want]


def test_learnt_pieces_grow_and_start_anew(monkeypatch):
    monkeypatch.setattr(X, "MEMO", 3000)
    enc = X.Encoder(X.tokenizer_path("word_bpe_49k.json"))
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + j % 26)}x{j}" for j in range(400)) for k in range(40)]
    for k in range(0, 40, 4):
        ids, _ = enc.encode([t.encode() for t in texts[k : k + 4]])
        assert ids.tolist() == [x for t in texts[k : k + 4] for x in enc.tokenizer.encode(t, add_special_tokens=False).ids]
