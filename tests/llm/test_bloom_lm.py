import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duskveil.llm import bloom_lm as X
from duskveil.llm import common as C

from . import cases


def tokens(t):
    return [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]


def brute(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        ts = tokens(t)
        out.append((d, held(d), len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)))
    return out


def check(got, rows):
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    order = lambda r: (repr(r[0]), r[2], r[3], r[5])
    a, b = sorted([(*(r[c] for c in cols), r["base_score"]) for r in got], key=order), sorted(brute(rows), key=order)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert np.allclose([x[5] for x in a], [x[5] for x in b])
    assert all(r["score"] <= 1e-9 and math.isfinite(r["score"]) for r in got)


def test_cases(spark, tmp_path):
    check(X.op6_lm_score(spark, cases.write(spark, tmp_path)).collect(), [r[:2] for r in cases.rows()])
    assert X.op6_lm_score(spark, cases.write(spark, tmp_path / "none", [])).count() == 0
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1)
    rows = [(held, "only a held-out text", "en", "s", 0, 0, "")]
    check(X.op6_lm_score(spark, cases.write(spark, tmp_path / "held", rows)).collect(), [r[:2] for r in rows])


def plain_scores(rows, model, levels):
    """Scores by the formula, token by token; ``levels`` maps n-grams' keys to levels."""
    out = []
    for d, t in rows:
        h, _ = X.Tokens()([(t or "").encode()])
        both, own = levels(X.pair_keys(h), 1), levels(h, 0)
        before = np.concatenate([levels(np.array([X.END], np.uint64), 0), own[:-1]])
        total = 0.0
        for b, v, w in zip(X.VALUES[both], X.VALUES[before], X.VALUES[own]):
            p = (w + 0.5) / (model.n + 0.5 * (model.v + 1))
            total += math.log10((min(b, v) + model.mu * p) / (v + model.mu))
        out.append((d, total))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [X.CHUNK, 500])
def test_documents(spark, monkeypatch, chunk):
    monkeypatch.setattr(X, "CHUNK", chunk)
    rows = [(r["doc_id"], r["text"]) for r in C.table(spark, cases.SF, "documents").collect()]
    seen, real = [], X.train
    monkeypatch.setattr(X, "train", lambda *a: seen.append(real(*a)) or seen[-1])
    got = X.op6_lm_score(spark, cases.SF).collect()
    check(got, rows)
    model, counts = seen[0]
    held = {r["bucket"]: X.Segment(np.frombuffer(r["segment"], np.uint8)) for r in counts.collect()}

    def from_filter(keys, salt):
        out, own = np.zeros(len(keys), np.int64), X.bucket_of(keys, model.buckets)
        for b in np.unique(own).tolist():
            out[own == b] = held[b].levels(keys[own == b], salt) if b in held else 0
        return out

    h, _ = X.Tokens()([(t or "").encode() for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1])
    exact = [dict(zip(*(x.tolist() for x in np.unique(k, return_counts=True)))) for k in (h, X.pair_keys(h))]
    ids, found = zip(*sorted(((r["doc_id"], r["score"]) for r in got), key=repr))
    by_filter = plain_scores(rows, model, from_filter)
    by_counts = plain_scores(rows, model, lambda keys, salt: X.level(np.array([exact[salt].get(k, 0) for k in keys.tolist()])))
    assert list(ids) == [d for d, _ in by_filter] and np.allclose(found, [x for _, x in by_filter])
    off = np.array([x for _, x in by_counts]) / np.array(found) - 1  # what the filter's false positives do
    assert abs(off.mean()) < 0.01 and (abs(off) < 0.02).mean() > 0.9


def test_score_follows_the_counts(spark):
    text = "one two three four " * 50
    docs = cases.table(spark, [(k, text, "en", "s", 0, 0, "") for k in range(40)])
    model, counts = X.train(docs, sample=docs)
    got = {r["doc_id"]: r for r in X.score(cases.table(spark, [(1, text, "", "", 0, 0, ""), (2, "four three two one " * 50, "", "", 0, 0, "")]), model, counts).collect()}
    assert got[1]["score"] > 0.2 * got[1]["base_score"] and got[2]["score"] < got[1]["score"] and abs(got[1]["base_score"] - got[2]["base_score"]) < 1e-6


def test_filter_holds_what_it_was_given():
    keys = np.sort(C.mix64(np.arange(20_000, dtype=np.uint64)))
    n = np.arange(20_000) % 300 + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    f = X.Segment(np.frombuffer(X.segment((keys, n), none, X.bits_for(int(X.level(n).sum()))), np.uint8))
    got = f.levels(keys, 0)
    assert (got >= X.level(n)).all() and (got > X.level(n)).mean() < 0.05  # one-sided errors, few
    assert (f.levels(C.mix64(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64)), 0) > 0).mean() < 0.05


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(1, 2**62), max_size=50))
def test_pack(values):
    keys = np.array(sorted(values), np.uint64)
    n = np.array([values[int(k)] for k in keys], np.int64)
    got = X.unpack(X.pack(keys, n))
    assert (got[0] == keys).all() and (got[1] == n).all()
    assert (X.unpack(X.pack(keys))[0] == keys).all()


def test_no_count_is_left_out(spark):
    rows = [(k, " ".join(f"w{(k * j) % 97}" for j in range(60)), "en", "s", 0, 0, "") for k in range(60)]
    model, counts = X.train(cases.table(spark, rows))
    h, _ = X.Tokens()([r[1].encode() for r in rows])
    segments = {r["bucket"]: np.frombuffer(r["segment"], np.uint8) for r in counts.select("bucket", "segment").collect()}
    for salt, stream in enumerate((h, X.pair_keys(h))):
        keys, n = np.unique(stream, return_counts=True)
        own = X.bucket_of(keys, model.buckets)
        for b in np.unique(own).tolist():
            got = X.Segment(segments[b]).levels(keys[own == b], salt)
            assert (got >= X.level(n[own == b])).all()
    for entries in (10**3, 10**6, 10**9, 10**10):  # no size at which a segment stops growing
        assert X.bits_for(entries) >= entries * X.HASHES / math.log(2)


def test_mu_is_fit_to_all_training_documents(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, "one two three four " * 30 if k % 8 else " ".join(f"w{x}" for x in rng.integers(0, 4000, 300)), "en", "s", 0, 0, "") for k in range(200)]
    seen, real = [], X.fit_mu
    monkeypatch.setattr(X, "fit_mu", lambda *a: seen.append(real(*a)) or seen[-1])
    X.op6_lm_score(spark, cases.write(spark, tmp_path, rows)).count()
    texts = [tokens(t) for d, t, *_ in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    stream = [(a, b) for x in texts for a, b in zip([None, *x], x)]
    words, pairs = Counter(b for _, b in stream), Counter(stream)
    n, v = sum(words.values()), len(words)
    value = lambda c: max(X.VALUES[X.level(np.array(c))] - 1, 0.0)
    total = dict.fromkeys(X.MUS.tolist(), 0.0)
    for (a, b), k in pairs.items():
        before, p = value(words[a]), (value(words[b]) + 0.5) / (n + 0.5 * (v + 1))
        for mu in total:
            total[mu] += k * math.log10((min(value(k), before) + mu * p) / (before + mu))
    assert seen == [max(total, key=total.get)]
