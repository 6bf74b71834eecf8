"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, probed for smoothed probabilities.

Tokens are runs of bytes other than ASCII white space, A-Z lower-cased, then one end. Words and word pairs are counted
over all training texts: each task counts what it has and deals sorted, packed counts to hash buckets; a bucket sums
them exactly. A bucket then writes its own segment of the filter: a count of level q (thresholds 1, 2, 3, 4, 6, 8, 11, 16, ...)
sets the bits of (n-gram, 1) to (n-gram, q). A probe asks for level 1, 2, ... until one is missing.

A segment is sized from the entries of its bucket and holds all of them, at every size of input, so the filter grows with the corpus
and no broadcast could hold it. The probes go to the segments instead: texts are taken in chunks of about ``CHUNK`` tokens, the
distinct n-grams of a chunk go to their buckets, where the segments are probed, and levels of one byte come back to the
chunk. The bucket has its words' exact counts too, which give the base score.

P(w|v) = (c(v w) + mu P(w)) / (c(v) + mu), with P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); mu is the best of a grid for all
training texts, each left out of its own counts. A token's probability follows from three levels, so numbers of tokens by
levels are all that the choice of mu needs.

Defined results: a null or empty text has the end alone; very long texts are scored whole, in a chunk of their own; without training texts, N and V are 0
and the base score is 0; repeated rows are texts of their own; a null id counts as an empty one; an empty table gives an empty result; extra columns
don't matter. Words and pairs are told apart by hashes of 64 and 48 bits. Texts are read once for the questions and once for the answers, so
``docs`` must be a plain read (or a staged table); chunks that differed between the two would be noticed and raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

HASHES = 6
END = 0x5E5E5E5E5E5E5E5F
FLUSH = 3_000_000
CHUNK = 1_500_000
#: Buckets at most: a task's counts are dealt to each of them.
MOST_BUCKETS = 1 << 16
#: Each byte as a word has it: A-Z lower-cased; ASCII white space parts words.
LETTERS = bytes(32 if 9 <= x <= 13 else x + 32 if 65 <= x <= 90 else x for x in range(256))
MUS = np.array([4.0**k for k in range(-1, 14)])
#: The smallest count of each level, made by rule.
LEVELS = np.unique(np.round(2.0 ** (np.arange(0, 120) / 2)).astype(np.int64))
#: What a level stands for: the geometric mean of its smallest and largest count; 0 for no level.
VALUES = np.concatenate([[0.0], np.sqrt(LEVELS * (np.append(LEVELS[1:], LEVELS[-1] * 2) - 1.0))])
VALUES[1] = 1.0
WAYS = len(LEVELS) + 1
PAIR_BITS = np.uint64(16)  # pairs keep the upper 48 bits of their hash


def pack(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Ascending uint64 keys, and their counts where there are any: byte planes of differences, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    more = b"" if counts is None else counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + steps + more)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(data[:8], "little")
    plane = lambda at, n: np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").reshape(-1)
    return np.cumsum(plane(8, n), dtype=np.uint64), plane(8 + 8 * n, n if len(data) > 8 + 8 * n else 0).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their (summed) counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else np.zeros(0, np.int64)


class Tokens:
    """Hash streams of texts: the hashes of the words, then END."""

    def __init__(self):
        self.words = C.Words(LETTERS)

    def __call__(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all texts, tokens of each text)."""
        h, n = self.words(raws)
        return np.insert(h, np.cumsum(n), np.uint64(END)), n + 1


def pair_keys(h: np.ndarray) -> np.ndarray:
    """A key for each token and the one before it; END stands before a text's first, as it ends the text before."""
    before = np.concatenate([np.array([END], np.uint64), h[:-1]])
    return C.mix64(before * np.uint64(C.GOLDEN) + h, 6) >> PAIR_BITS << PAIR_BITS


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return C.below(keys, buckets)


def count_ngrams(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """A row for each bucket: words (packed, with exact counts), n (tokens), v (distinct words), and its segment of the filter."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, size = Tokens(), [], 0

        def flush():
            h = np.concatenate(held)
            rows = []
            for kind, keys in ((1, h), (2, pair_keys(h))):
                keys, n = summed(keys)
                at = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                rows += [(kind, b, pack(keys[x:y], n[x:y])) for b, (x, y) in enumerate(zip(at, at[1:])) if x < y]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "bucket", "packed"])

        for b in (y for x in it for y in C.batches([x], 4 << 20)):
            h, _ = tokens(C.utf8(b.column(0)))
            held.append(h)
            size += len(h)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held, entries = {}, 0
        for kind in (1, 2):
            parts = [unpack(x) for x in pdf.loc[pdf["kind"] == kind, "packed"]] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            held[kind] = summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
            entries += int(level(held[kind][1]).sum())
        words, n = held[1]
        return pd.DataFrame({"bucket": [int(key[0])], "words": [pack(words, n)], "n": [int(n.sum())], "v": [len(n)], "segment": [segment(held[1], held[2], bits_for(entries))]})

    return docs.select(text).mapInArrow(C.tidied(count), "kind int, bucket int, packed binary").groupBy("bucket").applyInPandas(add, "bucket int, words binary, n long, v long, segment binary")


def bits_for(entries: int) -> int:
    """The bits of a segment that holds so many entries."""
    return (math.ceil(entries * HASHES / math.log(2)) + 512) // 8 * 8


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


def _positions(keys: np.ndarray, q: int, bits: int) -> Iterator[np.ndarray]:
    """The bit positions of (key, level q) within its segment, one hash after the other."""
    h = C.mix64(keys, 100 + q)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield (((a + np.uint64(k) * b) & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)


def segment(words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], bits: int) -> bytes:
    """The filter's bits for the n-grams (keys, counts) of one bucket."""
    out = np.zeros(bits, np.uint8)
    for salt, (keys, n) in enumerate((words, pairs)):
        keys, q = keys ^ np.uint64(salt), level(n)
        for j in range(1, int(q.max(initial=0)) + 1):
            for at in _positions(keys[q >= j], j, bits):
                out[at.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


@dataclass
class Segment:
    """A bucket's part of the filter."""

    raw: np.ndarray

    def levels(self, keys: np.ndarray, salt: int) -> np.ndarray:
        """The level of each key: probes go on until a level is missing."""
        out, bits = np.zeros(len(keys), np.int64), 8 * len(self.raw)
        if not bits:
            return out
        left, salted = np.arange(len(keys)), keys ^ np.uint64(salt)
        for j in range(1, len(LEVELS) + 1):
            alive = np.ones(len(left), bool)
            for at in _positions(salted, j, bits):
                alive &= (self.raw[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            left, salted = left[alive], salted[alive]
            if not len(left):
                break
            out[left] = j
        return out


@dataclass
class Model:
    buckets: int
    n: int
    v: int
    mu: float = 1.0

    def log10(self, codes: np.ndarray, mu: float, out: int = 0) -> np.ndarray:
        """The log probability of tokens by their codes (see ``codes_of``). ``out``: what the text itself adds to each count."""
        both, before, own = (np.maximum(VALUES[x] - out, 0.0) for x in (codes // WAYS**2, codes // WAYS % WAYS, codes % WAYS))
        p = (own + 0.5) / (self.n + 0.5 * (self.v + 1))
        return np.log10((np.minimum(both, before) + mu * p) / (before + mu))


def codes_of(both: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One number for the levels of a pair, of its first word and of its second."""
    return (both.astype(np.int64) * WAYS + before) * WAYS + own


def train(docs: DataFrame, text: str = "text", sample: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """A model of ``docs``, and the counts and segments it was made from (a row for each bucket). ``sample``: texts that mu is fit to."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * docs.rdd.getNumPartitions(), MOST_BUCKETS))
    counts, _ = C.stage(count_ngrams(docs, text, buckets), "ngram-counts", "none")
    C.release_shuffles(spark)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    model = Model(buckets, int(total["n"]), int(total["v"]))
    if sample is not None:
        rows = sample.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(True).alias("fit"))
        model.mu = fit_mu(probe(rows, model, counts, MUS[:0]), model)
    return model, counts


def fit_mu(probed: DataFrame, model: Model) -> float:
    """The mu of the grid under which the texts marked for the fit are most probable, each left out of its own counts."""
    cells = probed.where(F.col("codes").isNotNull()).select(F.explode(F.arrays_zip("codes", "code_n")).alias("x"))
    got = cells.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.code_n").alias("n")).orderBy("code").collect()  # WAYS**3 rows at most
    if not got:
        return 1.0
    codes, n = np.array([r["code"] for r in got]), np.array([r["n"] for r in got])
    total = [float((model.log10(codes, mu, out=1) * n).sum()) for mu in MUS]
    return float(MUS[int(np.argmax(total))])


def _chunks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, places, ids, whether each row is for the fit, tokens of each, hashes) of chunks of rows (rid, doc_id, text, fit)."""
    tokens, held, size = Tokens(), [], 0

    def joined():
        rids, ids = (pa.concat_arrays([x[k] for x in held]) for k in (0, 1))
        fit, sizes, h = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
        name = xxhash.xxh3_64_intdigest(h.tobytes(), seed=rids[0].as_py()) - (1 << 63)
        return name, rids, ids, fit, sizes, h

    for b in (y for x in it for y in C.batches([x], 4 << 20)):
        h, sizes = tokens(C.utf8(b.column(2)))
        held.append((b.column(0), b.column(1), b.column(3).to_numpy(zero_copy_only=False).astype(bool), sizes, h))
        size += len(h)
        if size >= CHUNK:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def probe(docs: DataFrame, model: Model, counts: DataFrame, mus: np.ndarray) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, fit): doc_id, n_tokens, n_known, base, and scores (for each of ``mus``). The first row of a
    chunk has codes and code_n, the numbers of tokens of its ``fit`` texts by levels."""
    spark, buckets = docs.sparkSession, model.buckets
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, _, _, h in _chunks(it):
            keys = [np.unique(h), np.unique(pair_keys(h))]
            cuts = [np.searchsorted(bucket_of(x, buckets), np.arange(buckets + 1)) for x in keys]
            own = np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)).tolist()
            asked = [pa.array([pack(x[c[b] : c[b + 1]]) for b in own], pa.binary()) for x, c in zip(keys, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.int64()), pa.array(own, pa.int32()), *asked], ["chunk", "bucket", "words", "pairs"])

    def answer(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        own = Segment(np.frombuffer(held["segment"][0].as_py(), np.uint8) if held.num_rows else np.zeros(0, np.uint8))
        known, exact = unpack(held["words"][0].as_py()) if held.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        out: dict[str, list] = {"counts": [], "words": [], "pairs": []}
        for salt, name in enumerate(("words", "pairs")):
            for some in C.chunks([unpack(x)[0] for x in asked[name].to_pylist()], 500_000, len):
                keys = np.concatenate(some)
                ends = np.cumsum([len(x) for x in some])
                got = {name: own.levels(keys, salt).astype(np.uint8)}
                if not salt:
                    at = np.searchsorted(known, keys)
                    got["counts"] = np.where(np.append(known, np.uint64(0))[at] == keys, np.append(exact, 0)[at], 0).astype("<i8")
                for k, v in got.items():
                    out[k] += [x.tobytes() for x in np.split(v, ends[:-1])]
        return pa.table([asked["chunk"], asked["bucket"], *(pa.array(out[k], pa.binary()) for k in out)], ["chunk", "bucket", *out])

    def body(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rids, ids, fit, sizes, h in _chunks(it):
            words, at = np.unique(h, return_inverse=True)
            often = np.argsort(-np.bincount(at), kind="stable")  # frequent words get small numbers, which take little room
            number = np.empty(len(often), np.int64)
            number[often] = np.arange(len(often))
            order = zstandard.ZstdCompressor(level=1).compress(number[at].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
            rank = zstandard.ZstdCompressor(level=1).compress(number.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
            cells = [pa.array([x], pa.binary()) for x in (pack(words), rank, order, fit.tobytes(), sizes.astype("<i8").tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *cells], ["chunk", "ids", "words", "rank", "order", "fit", "sizes"])

    planes = lambda raw: np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)

    def gather(key: tuple, body: pa.Table, answers: pa.Table) -> pa.Table:
        one = {k: body[k][0].as_py() for k in ("words", "rank", "order", "fit", "sizes")}
        ids = body["ids"].combine_chunks().flatten()
        fit, sizes = np.frombuffer(one["fit"], bool), np.frombuffer(one["sizes"], "<i8")
        words = unpack(one["words"])[0]
        at = np.argsort(planes(one["rank"]))[planes(one["order"])]
        h = words[at]
        answers = answers.sort_by("bucket")  # buckets are ranges of hashes: in order
        of_word, of_pair, count = (np.frombuffer(b"".join(answers[k].to_pylist()), t) for k, t in (("words", np.uint8), ("pairs", np.uint8), ("counts", "<i8")))
        pairs, pair = np.unique(pair_keys(h), return_inverse=True)
        if len(of_word) != len(words) or len(of_pair) != len(pairs):
            raise ValueError("the texts of a chunk changed between two reads")
        own = of_word[at]
        end = of_word[np.searchsorted(words, np.uint64(END))]
        codes, code = np.unique(codes_of(of_pair[pair], np.concatenate([[end], own[:-1]]), own), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        scores = np.array([np.add.reduceat(model.log10(codes, mu)[code], starts) for mu in mus]).reshape(len(mus), len(sizes))
        base = np.log10(count + 0.5) - math.log10(model.n + 0.5 * (model.v + 1))
        cells = np.bincount(code[np.repeat(fit, sizes)], minlength=len(codes))
        some, none = np.flatnonzero(cells), [None] * (len(sizes) - 1)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * len(mus), pa.int32()), pa.array(scores.T.reshape(-1)))
        return pa.table(
            [ids, pa.array(sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64)[at], starts)), pa.array(np.add.reduceat(base[at], starts)), flat,
             pa.array([codes[some] if len(some) else None, *none], pa.list_(pa.int64())), pa.array([cells[some] if len(some) else None, *none], pa.list_(pa.int64()))],
            ["doc_id", "n_tokens", "n_known", "base", "scores", "codes", "code_n"],
        )

    rows = C.placed(docs, "rid").select("rid", "doc_id", "text", "fit")
    asks = rows.mapInArrow(C.tidied(ask), "chunk long, bucket int, words binary, pairs binary")
    found = asks.groupBy("bucket").cogroup(counts.select("bucket", "words", "segment").groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, counts binary, words binary, pairs binary")
    answers, path = C.stage(found, "lm-levels")
    C.release_shuffles(spark)  # of the questions, before the chunks are shuffled
    bodies = rows.mapInArrow(C.tidied(body), f"chunk long, ids array<{kind}>, words binary, rank binary, order binary, fit binary, sizes binary")
    each = bodies.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(gather, f"doc_id {kind}, n_tokens long, n_known long, base double, scores array<double>, codes array<long>, code_n array<long>")
    out, _ = C.stage(each, "lm-scores")
    C.drop_path(spark, path)
    C.release_shuffles(spark)
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text", fit: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row. ``fit``: the rows that mu is fit to on the way."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.lit(False) if fit is None else fit).alias("fit"))
    each = probe(rows, model, counts, np.array([model.mu]) if fit is None else MUS)
    if fit is not None:
        model.mu = fit_mu(each, model)
    mine = F.col("scores")[0 if fit is None else MUS.tolist().index(model.mu)]
    return each.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), mine.alias("score"))


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = train(docs.where(C.in_train(held=1)))
    C.release_shuffles(spark)
    out = score(docs, model, counts, fit=C.in_train(held=1))
    return out.select("doc_id", (C.held_remainder() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
