import numpy as np
import pytest

from duskveil.llm import common as C
from duskveil.llm import suffix_family as X

from . import cases


def brute(rows, length=100):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[: len(raw)]])
        out.append((rows[k][0], len(raw), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0, X.digest(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_cases(spark, tmp_path, batches):
    docs = cases.table(spark).coalesce(1)
    docs.write.parquet(f"{tmp_path}/t")
    got = X.dedup(spark.read.parquet(f"{tmp_path}/t"), batches=batches).collect()
    mine = sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), X.digest(r["kept"])) for r in got), key=repr)
    assert mine == brute([tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").select("doc_id", "text").collect()])


def test_empty(spark, tmp_path):
    assert X.op5_suffix_dedup(spark, cases.write(spark, tmp_path, [])).count() == 0


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in C.table(spark, cases.SF, "documents").collect()]
    want = brute(rows)
    assert cases.collected(X.op5_suffix_dedup(spark, cases.SF)) == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("large", [X.LARGE, 3])
def test_pieces_that_overlap(spark, tmp_path, monkeypatch, large):
    """Passages cut from each other, shifted and edited: many classes for one anchor."""
    monkeypatch.setattr(X, "LARGE", large)
    rng = np.random.default_rng(6)
    body = "".join(rng.choice(list("ab c"), 900))
    rows = []
    for k in range(60):
        i, n = int(rng.integers(0, 700)), int(rng.integers(60, 400))
        t = body[i : i + n]
        if k % 3 == 0 and n > 80:
            t = t[:40] + "é" + t[41:]
        rows.append((k, f"{k}" * int(rng.integers(0, 30)) + t + ("ab" * 90 if k % 7 == 0 else ""), "en", "s", 0, 0, ""))
    assert cases.collected(X.op5_suffix_dedup(spark, cases.write(spark, tmp_path, rows))) == brute([r[:2] for r in rows])


def test_levels_grow_geometrically(spark):
    rows = X.numbered(C.table(spark, cases.SF, "documents"), "doc_id", "text")
    family = X.Family(spark, 4)
    sizes = []
    for part in X.batches_of(rows, "doc_id", 7):
        family.append(part)
        sizes.append([n for n, _, _ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1]]
    entries = np.concatenate([X.unpack(r["packed"]) for _, level, _ in family.levels for r in level.collect()])
    keys = entries[list(X.CLASS)]
    assert len(np.unique(keys)) == len(keys) > 1000
    one = X.unpack(family.levels[0][1].first()["packed"])
    assert (X.ordered(one) == one).all()


def kept_rows(spark, rows, marks):
    """doc_id and what stays of it, from marks (rid, first, end)."""
    gone = {}
    for r in marks.collect():
        gone.setdefault(r["rid"], []).append((r["first"], r["end"]))
    out = []
    for r in rows.collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        stay = np.ones(len(raw), bool)
        for a, b in gone.get(r["rid"], ()):
            stay[a:b] = False
        out.append((r["doc_id"], X.digest(bytes(raw[stay]))))
    return sorted(out, key=repr)


def test_matches_come_from_the_family(spark, monkeypatch):
    """Without what the merge-scans find, nothing is removed: no other path finds repeats."""
    docs = C.table(spark, cases.SF, "documents")
    rows = X.numbered(docs, "doc_id", "text")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    family = X.Family(spark, 4)
    found = [family.append(part) for part in X.batches_of(rows, "doc_id", 3)]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    assert kept_rows(spark, rows, X.matched(every, rows, 4)) == sorted(((d, h) for d, *_, h in want), key=repr)
    assert X.matched(every.limit(0), rows, 4).count() == 0


def test_a_saved_family_takes_another_batch(spark, tmp_path):
    docs = C.table(spark, cases.SF, "documents")
    rows = X.numbered(docs, "doc_id", "text")
    first, second, third = X.batches_of(rows, "doc_id", 3)
    family = X.Family(spark, 5, f"file://{tmp_path}/family")
    found = family.append(first).unionByName(family.append(second))
    family.save()
    again = X.Family.open(spark, f"file://{tmp_path}/family")
    assert [n for n, _, _ in again.levels] == [1, 1] and again.shards == 5
    found = found.unionByName(again.append(third))
    again.save()
    assert [n for n, _, _ in X.Family.open(spark, f"file://{tmp_path}/family").levels] == [2, 1]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert kept_rows(spark, rows, X.matched(found, rows, 5)) == sorted(((d, h) for d, *_, h in want), key=repr)


def test_strings_are_compared_by_their_bytes():
    raws = [b"a" * 150, b"x" + b"a" * 120, b"ab" * 80]
    seen, want = set(), []
    for r in raws:
        for i in range(len(r) - 99):
            want.append(r[i : i + 100] in seen)
            seen.add(r[i : i + 100])
    assert X._again(raws).tolist() == want


def test_anchors_cover_every_string():
    rng = np.random.default_rng(3)
    raws = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (0, 99, 100, 101, 5000, 30)] + [b"a" * 300]
    s = X.Sample(raws)
    starts = [(int(s.doc[k]), i - int(s.starts[s.doc[k]])) for k in range(len(s.anchor)) for i in range(s.first[k], s.last[k] + 1)]
    assert sorted(starts) == [(d, i) for d, r in enumerate(raws) for i in range(len(r) - 99)]
    assert all(s.first[k] + 76 >= s.anchor[k] >= s.last[k] for k in range(len(s.anchor)))
    both = X.Sample([raws[4]])
    assert len(both.anchor) < 5000 / 30 and (both.keys()[:, 0] == s.keys()[s.doc == 4][:, 0]).all()
