import numpy as np
import pytest

from duskveil.llm import common as C
from duskveil.llm import dart_minhash as X
from duskveil.llm.decontaminate import words

from . import cases


def brute(rows, similarity=0.8, by_text=False):
    """doc_id, class_id and class size of each row, from all pairs of shingle sets. ``by_text``: wordless texts are copies where they are equal."""

    def shingles(t):
        ws = words((t or "").encode())
        return frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4)) if ws)

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for k, s in enumerate(sets):
        for x in s or [rows[k][1] or "" if by_text else None]:
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in by.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if len(x & y) >= similarity * len(x | y):  # two without shingles are
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    name = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted(((d, name[find(k)], len(groups[find(k)])) for k, (d, _) in enumerate(rows)), key=repr)


def test_cases(spark, tmp_path):
    assert cases.collected(X.op2_near_dedup(spark, cases.write(spark, tmp_path))) == brute([r[:2] for r in cases.rows()])
    assert X.op2_near_dedup(spark, cases.write(spark, tmp_path / "none", [])).count() == 0


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in C.table(spark, cases.SF, "documents").collect()]
    assert cases.collected(X.op2_near_dedup(spark, cases.SF)) == brute(rows)


@pytest.mark.parametrize("block,rounds", [(X.BLOCK, X.ROUNDS), (8, 1)])
def test_drifting_copies(spark, tmp_path, monkeypatch, block, rounds):
    """A group whose members are similar to some of the others only: no link of the chain is lost."""
    monkeypatch.setattr(X, "BLOCK", block)
    monkeypatch.setattr(X, "ROUNDS", rounds)
    rng = np.random.default_rng(2)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(150):
        ws = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            ws[at] = f"x{rng.integers(10**6)}"
        if k % 10 == 0:
            base[int(rng.integers(120))] = f"y{k}"
        rows.append((k, " ".join(ws), "en", "s", 0, 0, ""))
    assert cases.collected(X.op2_near_dedup(spark, cases.write(spark, tmp_path, rows))) == brute([r[:2] for r in rows])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = C.mix64(np.arange(3000, dtype=np.uint64))
    for n, share in ((5, 3), (200, 180), (1500, 700)):
        a, b = pool[:n], pool[n - share : 2 * n - share]
        got = [(lambda s: (s[0] == s[1]).mean())(X.signatures([C.mix64(a, k), C.mix64(b, k)])) for k in range(30)]
        assert abs(np.mean(got) - share / (2 * n - share)) < 0.04
    x, y = rng.uniform(0.2, 4, 80), rng.uniform(0.2, 4, 80)
    got = [(lambda s: (s[0] == s[1]).mean())(X.signatures([C.mix64(pool[:80], k)] * 2, [x, y])) for k in range(40)]
    assert abs(np.mean(got) - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04
    assert (X.signatures([pool[:1], pool[:0], pool[:700]])[[0, 2]] != 0).all()


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(k, k + 1) for k in range(60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (200, 2)) if a != b]
    got = {r["cid"]: r["root"] for r in X.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in list(parent) if find(x) != x}


def test_bloom_holds_all(spark):
    ids = spark.range(5000).selectExpr("xxhash64(id) as cid")
    f = C.bloom(ids, 5000).value
    have = np.array([r["cid"] for r in ids.collect()], np.int64)
    assert C.may_hold(have, f).all() and C.may_hold(C.mix64(np.arange(10_000, dtype=np.uint64), 3).view(np.int64), f).mean() < 0.05
