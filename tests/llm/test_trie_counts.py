import math
import random
import re
from collections import Counter

import numpy as np

from duskveil.llm import common as C
from duskveil.llm import sentencepiece_backend as S
from duskveil.llm import trie_counts as X

from . import cases


def best(token, scores, unknown, fallback):
    """Forward scores of one pre-token alone."""
    top = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for a in range(len(token)):
        for b in range(a + 1, len(token) + 1):
            s = scores.get(token[a:b])
            n = 1
            if s is None and b == a + 1:
                s, n = unknown, len(token[a].encode()) if fallback else 1
            if s is not None and top[a][0] + s > top[b][0]:
                top[b] = (top[a][0] + s, top[a][1] + n)
    return top[-1]


def pretokens(t):
    return [x for k, line in enumerate((S.MARK + t.replace(" ", S.MARK)).split("\n") if t else []) for x in ["\n"] * bool(k) + re.findall(f"{S.MARK}+[^{S.MARK}]*|[^{S.MARK}]+", line)]


def brute(rows):
    """Log probabilities from the library's tokens of all rows, then the best path of each pre-token alone."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    n = Counter(k for _, t in rows for k in library.encode(t or ""))
    own = {p: n[k] + 0.5 for k, (p, _, kind) in enumerate(S.ModelFile.load(S.model_path()).pieces) if kind == S.NORMAL}
    total = sum(own.values())
    scores = {p: math.log(c / total) for p, c in own.items()}
    unknown, out, memo = min(scores.values()) - 10, [], {}
    for d, t in rows:
        cut = pretokens(t or "")
        for x in set(cut).difference(memo):
            memo[x] = best(x, scores, unknown, True)
        out.append((d, len(cut), sum(memo[x][1] for x in cut), round(sum(memo[x][0] for x in cut), 3)))
    return sorted(out, key=repr)


def rounded(df):
    return sorted(((r["doc_id"], r["n_pretokens"], r["n_tokens"], round(r["score"], 3)) for r in df.collect()), key=repr)


def test_cases(spark, tmp_path, monkeypatch):
    assert rounded(X.op10_token_counts(spark, cases.write(spark, tmp_path))) == brute([r[:2] for r in cases.rows()])
    assert X.op10_token_counts(spark, cases.write(spark, tmp_path / "none", [])).count() == 0


def test_documents(spark):
    docs = C.table(spark, cases.SF, "documents").where("length(text) < 600").limit(12).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert rounded(X.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), S.model_path())) == brute(rows)


def test_small_trie_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS", 7)
    model = S.ModelFile.load(S.model_path())
    words = ["▁" + "".join(random.Random(k).choice("thearin") for _ in range(9)) for k in range(300)]
    trie = X.Trie(model)
    assert all(abs(s - best(w, trie.scores, trie.unknown, True)[0]) < 1e-6 for w, s in zip(words, trie.measure(words)[1]))
    known = C.Known(x=np.int64)
    for k in range(0, 100_000, 7_000):
        keys = C.mix64(np.arange(k, k + 14_000, dtype=np.uint64))
        at = known.learn(keys, lambda new, keys=keys: {"x": new + k})
        assert (known.keys[at] == keys).all() and (known.beside["x"][at[-7000:]] == np.arange(k + 7000, k + 14_000)).all()


def test_matches_the_unigram_lattice():
    from tokenizers import Tokenizer, models

    m = S.ModelFile(pieces=[("<unk>", 0.0, S.UNKNOWN), ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("a", -4.0, 1), ("b", -4.1, 1), ("abb", -3.5, 1), ("ba", -5.0, 1)], kind=S.UNIGRAM)
    t, trie = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], 0, False)), X.Trie(m)
    rng = random.Random(4)
    for _ in range(300):
        w = "▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        assert trie.measure([w])[0][0] == len(t.encode(w).ids)


def test_long_and_odd_pretokens():
    m = S.ModelFile.load(S.model_path())
    trie, rng = X.Trie(m), random.Random(7)
    words = ["▁" + "".join(rng.choice("thear é東\x00") for _ in range(n)) for n in (0, 1, 5, 38, 39, 40, 41, 90) for _ in range(6)] + ["\n", "▁▁▁"]
    for w, n, s in zip(words, *trie.measure(words)):
        score, want = best(w, trie.scores, trie.unknown, True)
        assert n == want and abs(s - score) < 1e-3, w


def test_the_models_own_count_is_that_of_sentencepiece(spark):
    import sentencepiece

    rows = [tuple(r) for r in C.table(spark, cases.SF, "documents").limit(120).select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["n_model_tokens"] for r in X.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), S.model_path()).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    assert got == {d: len(library.encode(t or "")) for d, t in rows}
