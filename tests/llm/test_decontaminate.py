import hashlib
import random
import re

from duskveil.llm import common as C
from duskveil.llm import decontaminate as X

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(rows, items, width=13):
    wins = {}
    for i, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - width + 1) if ws else 0):
            wins.setdefault(tuple(ws[k : k + width]), set()).add(str(i))
    out = []
    for d, t in rows:
        ws, hit, found = words(t), set(), set()
        for m in {len(w) for w in wins}:
            for k in range(len(ws) - m + 1):
                if own := wins.get(tuple(ws[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= own
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


def test_cases(spark, tmp_path):
    items = [(1, cases.rows()[4][1][:80]), (2, "Mixed case"), (3, None), (4, "--"), (5, "line"), (6, cases.rows()[4][1]), (6, "東京"), (None, "three"), (7, "word3 " * 3)]
    for k, bench in enumerate((items, [])):
        sf = cases.write(spark, tmp_path / str(k), benchmark=spark.createDataFrame(bench, "item_id long, text string"))
        assert cases.collected(X.op8_decontaminate(spark, sf)) == brute([r[:2] for r in cases.rows()], [(("" if i is None else i), t) for i, t in bench])


def test_documents_and_rounds(spark):
    docs, bench = C.table(spark, cases.SF, "documents").select("doc_id", "text"), C.table(spark, cases.SF, "benchmark")
    rows, items = [tuple(r) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]
    want = brute(rows, items)
    assert cases.collected(X.op8_decontaminate(spark, cases.SF)) == want and sum(r[2] for r in want) > 0
    out = X.mark_hits(docs, bench, max_broadcast=800).collect()
    assert sorted((r["doc_id"], r["_n_words"], r["_n_hit"], len(r["_items"])) for r in out) == sorted(r[:4] for r in want)


def test_search_against_plain_scan():
    rng = random.Random(2)
    for m in (1, 2, 3, 7, 13):
        text = [b"%d" % rng.randrange(3) for _ in range(400)]
        pats = {tuple(text[k : k + m]): k for k in range(0, 300, 37) if k + m <= 400}
        got = sorted(X.WuManber(m, pats).search(text))
        assert got == sorted((k, pats[tuple(text[k : k + m])]) for k in range(400 - m + 1) if tuple(text[k : k + m]) in pats)


def test_columns_stay(spark):
    docs = cases.table(spark).selectExpr("*", "3 as _items", "1 as _mask", "2 as _found", "4 as rid", "5 as ranges")
    for most in (1 << 20, 3):
        out = X.mark_hits(docs, spark.createDataFrame([(1, "fox"), (2, "the quick brown")], "item_id long, text string"), max_broadcast=most)
        assert out.columns == [*docs.columns, "_n_words", "_n_hit", "__items"] and {(r["_items"], r["_mask"], r["rid"]) for r in out.collect()} == {(3, 1, 4)}
