"""Each stage against a plain version of it, on the stage's own input."""

import hashlib

import corpus_pipeline as P
from duskveil.llm import common as C
from duskveil.llm import toxicity

from . import cases, test_dart_minhash, test_decontaminate, test_line_mphf


def keyed(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


def steps(spark, sf):
    docs = C.table(spark, sf, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        docs, _ = C.stage(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def check(spark, sf):
    docs, calm, lines, unique, clean, last = steps(spark, sf)
    assert all(x.dtypes == docs.dtypes for x in (calm, lines, unique, clean))
    model = toxicity.fit_documents(docs, C.table(spark, sf, "labels"))
    f, w = toxicity.Featurizer(model.bits), model.dense()
    z = {t: model.bias + w[f((t or "").encode())].sum() if model.known else -99 for _, t in keyed(docs.collect())}
    assert keyed(calm.collect()) == [r for r in keyed(docs.collect()) if z[r[1]] < 0]
    rows = keyed(calm.collect())
    want = [(d, n) for d, _, _, n in test_line_mphf.brute(rows)]
    assert sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in lines.collect()), key=repr) == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.join(calm.select("doc_id", F_len("text", "was")), "doc_id").where("length(text) < was").collect())
    rows = keyed(lines.collect())
    groups = test_dart_minhash.brute(rows, by_text=True)
    assert sorted(((r["doc_id"]) for r in unique.collect()), key=repr) == sorted({c for _, c, _ in groups}, key=repr)
    assert set(keyed(unique.collect())) <= set(rows)
    rows = keyed(unique.collect())
    bench = [(r["item_id"], r["text"]) for r in C.table(spark, sf, "benchmark").collect()]
    hit = [r[0] for r in test_decontaminate.brute(rows, bench) if r[5]]
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((d for d, _ in rows if d not in hit), key=repr)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.sentencepiece_backend.model_path())
    got = sorted(((r["doc_id"], list(r["ids"])) for r in last.collect()), key=repr)
    assert got == sorted(((d, sp.encode(t or "")) for d, t in keyed(clean.collect())), key=repr)
    assert all(r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last.collect())
    return [x.count() for x in (docs, calm, lines, unique, clean, last)]


def F_len(column, name):
    from pyspark.sql import functions as F

    return F.length(column).alias(name)


def test_documents(spark):
    n = check(spark, cases.SF)
    assert n[0] >= n[1] == n[2] > n[3] > n[4] == n[5] > 0
    assert P.run(spark, cases.SF).count() == n[5]


def test_cases(spark, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")  # too few to teach anything: all stay
    bench = spark.createDataFrame([(1, "mixed case words 12 34")], "item_id long, text string")
    check(spark, cases.write(spark, tmp_path, cases.rows() + [(200, " . ", "en", "s", 3, 0, ""), (201, "!", "en", "s", 1, 0, ""), (202, "!", "en", "s", 1, 0, "")], labels=labels, benchmark=bench))
    none = cases.write(spark, tmp_path / "none", [], labels=labels.limit(0), benchmark=bench.limit(0))
    assert P.run(spark, none).count() == 0


def test_clashing_names(spark, tmp_path):
    """Columns of the input that have the names of the stages' own results stay as they are."""
    names = "_score _n_lines _n_dropped _n_words _n_hit _items _rid rid _maybe maybe _gone gone _mask _found found ranges root cid bands place n media"
    more = ", ".join(f"{k} as {n}" for k, n in enumerate(names.split()))
    to = cases.write(spark, tmp_path, labels=spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([(1, "mixed case words 12 34")], "item_id long, text string"))
    docs, _ = C.stage(cases.table(spark).drop("n", "media").selectExpr("*", *more.split(", ")), "clash")
    want = [tuple(range(len(names.split())))]
    for name, stage in P.STAGES[:-1]:
        out, _ = C.stage(stage(spark, docs, to), name)
        assert out.columns == docs.columns and out.count()
        assert [tuple(r) for r in out.select(*names.split()).distinct().collect()] == want, name
        docs = out
    assert P.STAGES[-1][1](spark, docs, to).count() == docs.count()


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
