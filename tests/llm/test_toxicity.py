import functools
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from duskveil.llm import common as C
from duskveil.llm import toxicity as X

from . import cases


def corpus(n):
    rng = np.random.default_rng(1)
    plain, bad = [f"w{k}" for k in range(400)], ["awful", "nasty", "vile"]
    rows, labels = [], []
    for k in range(n):
        ws = list(rng.choice(plain, 40))
        y = int(rng.random() < 0.2)
        if y:
            ws[5:5] = list(rng.choice(bad, 4))
        rows.append((k, " ".join(ws), "en", "s", 0, 0, ""))
        labels.append((k, 1, y))
    return rows, labels


def test_learns_and_scores_held_out(spark, tmp_path):
    rows, labels = corpus(1500)
    rows += [(10_000 + k, t, "en", "s", 0, 0, "") for k, t in enumerate([None, "", "nasty vile awful nasty", "x " * 30_000])]
    sf = cases.write(spark, tmp_path, rows, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in X.op3_toxicity(spark, sf).collect()}
    truth = {d: y for d, _, y in labels}
    held = [d for d in truth if got[d]["held_out"]]
    assert 200 < len(held) < 400
    assert np.mean([got[d]["predicted"] == truth[d] for d in held]) > 0.97
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[10_000]["score"] == got[10_001]["score"] < 0.5 < got[10_002]["score"]


def test_held_out_labels_teach_nothing(spark, tmp_path):
    import zlib

    rows, labels = corpus(400)
    kind = "doc_id long, quality int, toxic int"
    flipped = [(d, q, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, q, y in labels]
    runs = [cases.collected(X.op3_toxicity(spark, cases.write(spark, tmp_path / str(k), rows, labels=spark.createDataFrame(x, kind)))) for k, x in enumerate((labels, flipped))]
    assert runs[0] == runs[1]


def test_cases(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(4, 1, None), (5, 1, 1), (5, 1, 0), (None, 1, 1), (6, None, 0)], none.schema)
    for k, labels in enumerate((none, odd)):
        got = X.op3_toxicity(spark, cases.write(spark, tmp_path / str(k), labels=labels)).collect()
        assert len(got) == len(cases.rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert X.op3_toxicity(spark, cases.write(spark, tmp_path / "none", [], labels=none)).count() == 0
    model = X.Model(np.zeros(0, np.int64), np.zeros(0), 0.0, True)
    extra = cases.table(spark).selectExpr("*", "1 as _score")
    assert X.score(extra, model).columns == [*extra.columns, "__score"] and {r["_score"] for r in X.score(extra, model).collect()} == {1}


def test_features():
    f = X.Featurizer(18)
    assert len(f(b"")) == 0 and len(f(b"one")) == 2
    assert (f("One, two THREE".encode()) == f(b"one two three")).all()
    for text in (b"", b"one", b"one two three " * 50):
        assert (X.unpacked(X.packed(f(text))) == f(text)).all()
    assert C.utf8 and (f(b"a b c d") != f(b"d c b a")).any()


HASHER = C.Words(X.LETTERS)


@functools.cache
def h(x, seed=0):
    """The hash of one word."""
    x = np.frombuffer(x, np.uint8)
    return int(HASHER.hashes(x, np.zeros(1, np.int64), *[np.array([len(x)])] * 2)[seed][0])


def plain_features(text, bits):
    """Feature indices, word by word."""
    ws = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    out = [x for w in ws for x in (h(w), h(w.decode()[:5].encode(), 1))]
    for seed, gap in ((1, 1), (2, 2), (3, 3)):
        out += [(h(a) * C.GOLDEN + h(b) + seed) * C.MIX1 for a, b in zip(ws, ws[gap:])]
    out += [((h(a) * C.GOLDEN + h(b)) * C.GOLDEN + h(c) + 4) * C.MIX2 for a, b, c in zip(ws, ws[1:], ws[2:])]
    return sorted({x % 2**64 >> 64 - bits for x in out})


class PlainFtrl:
    """FTRL-proximal, a coordinate at a time."""

    def __init__(self, alpha=0.3, beta=1.0, l1=10.0, l2=1.0):
        self.alpha, self.beta, self.l1, self.l2, self.z, self.n = alpha, beta, l1, l2, {}, {}

    def weight(self, k):
        z, n = self.z.get(k, 0.0), self.n.get(k, 0.0)
        return 0.0 if abs(z) <= self.l1 else -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(n)) / self.alpha + self.l2)

    def learn(self, ks, y, times):
        p = 1 / (1 + math.exp(-sum(map(self.weight, ks))))
        for k, w in [(k, self.weight(k)) for k in ks]:
            g, n = (p - y) * times, self.n.get(k, 0.0)
            self.z[k] = self.z.get(k, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
            self.n[k] = n + g * g


def test_scores_are_those_of_plain_ftrl(spark):
    """The whole operator on the documents of the small folder, against plain Python: features, order of the sample, fit, scores, decisions."""
    docs = {r["doc_id"]: r["text"] or "" for r in C.table(spark, cases.SF, "documents").collect()}
    labels = C.table(spark, cases.SF, "labels").where("toxic in (0, 1)").select("doc_id", "toxic", F.xxhash64(F.col("doc_id").cast("string")).alias("k")).collect()
    rows = sorted((r["k"], r["doc_id"], r["toxic"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in docs)
    model, features = PlainFtrl(), {d: plain_features(t, X.BITS) for d, t in docs.items()}
    for epoch in range(2):
        for at in np.random.default_rng(epoch).permutation(len(rows)):
            _, d, y = rows[at]
            model.learn([*features[d], 1 << X.BITS], y, 4.0 if y else 1.0)
    want = {d: 1 / (1 + math.exp(-sum(map(model.weight, [*x, 1 << X.BITS])))) for d, x in features.items()}
    got = X.op3_toxicity(spark, cases.SF).collect()
    assert len(got) == len(docs) and len(rows) > 50
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-9 and r["predicted"] == (want[r["doc_id"]] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
