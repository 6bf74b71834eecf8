import hashlib
import random
import zlib

import pytest

from duskveil.llm import common as C
from duskveil.llm import media_chunks as X

from . import cases


def brute(text):
    raw = (text or "").encode()
    p = raw + b" " * (-len(raw) % 192 if raw else 192)
    wav = X.to_wav(p)
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), X.features(p)


def check(got, rows):
    cols = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got) == sorted(repr((d, *brute(t))) for d, t in rows)


def test_cases(spark, tmp_path):
    check(X.op4_media_chunks(spark, cases.write(spark, tmp_path)).collect(), [r[:2] for r in cases.rows()])
    assert X.op4_media_chunks(spark, cases.write(spark, tmp_path / "none", [])).count() == 0


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in C.table(spark, cases.SF, "documents").collect()]
    check(X.op4_media_chunks(spark, cases.SF).collect(), rows)


def test_cuts_follow_content():
    rng = random.Random(3)
    shared = bytes(rng.randrange(97, 123) for _ in range(60_000))
    a, b = b"x" * 700 + shared, bytes(rng.randrange(97, 123) for _ in range(9000)) + shared
    one, two = X.cut_all([a, b])
    assert b"".join(one) == a and b"".join(two) == b
    assert all(len(x) <= X.MAX for x in one + two) and all(len(x) >= X.MIN for x in one[:-1] + two[:-1])
    assert len(set(map(X.digest, one)) & set(map(X.digest, two))) >= len(one) - 3
    assert X.cut_all([b, a]) == [two, one] and X.cut_all([b"z" * 50_000])[0][0] == b"z" * X.MAX


def test_shared_chunks_are_stored_once(spark):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    rows = [(k, f"start {k} " * 50 + shared, "en", "s", 0, 0, "") for k in range(6)] + [(9, shared * 2, "en", "s", 0, 0, "")]
    column, at, dictionary = X.store_documents(cases.table(spark, rows))
    store = spark.read.parquet(at).collect()
    held = [x for r in store for x in r["held"]]
    assert len(held) == len(set(held)) and sum(len(r["missing"]) for r in store) > 20
    assert len(X.read_store(spark, at, dictionary).collect()) == 7
    wrong = spark.createDataFrame([(r["media"], r["recipe"], r["held"], [b"" if k == 0 else x for k, x in enumerate(r["blobs"])], r["lent"], r["missing"]) for r in store], X.STORE)
    wrong.write.parquet(to := C.new_path(spark, "wrong"))
    with pytest.raises(Exception):  # noqa: B017
        X.read_store(spark, to, dictionary).collect()


def test_wav():
    assert X.from_wav(X.to_wav(b"abc")) == b"abc"
    with pytest.raises(ValueError):
        X.from_wav(X.to_wav(b"abc") + b"d")
