import hashlib
from collections import Counter

import numpy as np

from duskveil.llm import common as C
from duskveil.llm import line_mphf as X

from . import cases

WHITE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_cases(spark, tmp_path):
    assert cases.collected(X.op7_line_dedup(spark, cases.write(spark, tmp_path))) == brute([r[:2] for r in cases.rows()])
    assert X.op7_line_dedup(spark, cases.write(spark, tmp_path / "none", [])).count() == 0


def test_documents_and_rounds(spark):
    docs = C.table(spark, cases.SF, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert cases.collected(X.op7_line_dedup(spark, cases.SF)) == brute(rows)
    out = X.drop_lines(docs, min_docs=2, keys_per_shard=5, max_broadcast=700)  # many shards, several rounds
    got = sorted(((r["doc_id"], r["_n_lines"], r["_n_dropped"], X.digest(r["text"] or "")) for r in out.collect()), key=repr)
    assert got == brute(rows, 2)


def test_columns_stay(spark):
    docs = cases.table(spark).selectExpr("*", "3 as _n_lines", "1 as h")
    out = X.drop_lines(docs)
    assert out.columns == [*cases.table(spark).columns, "_n_lines", "h", "__n_lines", "_n_dropped"] and {r["_n_lines"] for r in out.collect()} == {3}
    taken = docs.selectExpr("*", "1 as rid", "2 as gone", "3 as places")
    assert X.drop_lines(taken, min_docs=2, keys_per_shard=2, max_broadcast=100).columns == [*taken.columns, "__n_lines", "_n_dropped"]
    assert {r["text"] for r in out.where("doc_id = 0").collect()} == {None}


def test_mphf():
    for n in (0, 1, 2, 1000, 50_000):
        keys = C.mix64(np.arange(n, dtype=np.uint64))
        m = X.Mphf.from_bytes(X.Mphf.build(keys).to_bytes())
        assert sorted(m.index(keys).tolist()) == list(range(n))
        other = m.index(C.mix64(np.arange(n, n + 1000, dtype=np.uint64)))
        assert other.min() >= -1 and other.max() < max(1, n)


def test_a_rare_line_that_shares_32_bits_with_a_frequent_one_stays():
    def unmix(z, seed):
        back = lambda z, n: z ^ z >> n ^ z >> 2 * n  # noqa: E731  shifts of 22 and more
        z = back(z, 31) * pow(C.MIX2, -1, 1 << 64) % (1 << 64)
        z = back(z, 27) * pow(C.MIX1, -1, 1 << 64) % (1 << 64)
        return (back(z, 30) - (seed + 1) * C.GOLDEN) % (1 << 64)

    key = np.array([12345], np.uint64)
    mixed = int(C.mix64(key, 2002)[0])
    others = np.array([unmix(mixed ^ k, 2002) for k in range(1, 20_000)], np.uint64)  # the same upper 32 bits
    assert (C.mix64(others, 2002) >> np.uint64(32) == np.uint64(mixed >> 32)).all()
    m = X.Mphf.build(key)
    assert (m.index(others) == 0).any()
    shards = X.Shards([(0, m.to_bytes(), X.fingerprint(key).tobytes(), np.array([10], np.uint32).tobytes())], 1)
    assert shards.counts(key).tolist() == [10] and not shards.counts(others).any()
