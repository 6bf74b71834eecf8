"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of hashed words, stems (a word's first five characters), word pairs, triples, and
pairs that skip one or two words. Weights are learned by FTRL-proximal: learning rates for each coordinate, L1 for sparsity; the weights that
are not zero are broadcast (at most ``2**bits`` of them).

The fit takes a bounded sample of labelled rows: the ``max_rows`` labels with the smallest hash of doc_id, each text with at
most ``2**bits`` distinct features. Scores cover every whole text.

Defined results: a null or empty text has the bias alone; very long texts are scored whole; rows without label, or with a null label, teach
nothing; a label table without rows, or with too few to teach any weight, gives a score of 0.0 for every text; a row that repeats with the same
label teaches once; an empty table gives an empty result; extra columns stay, whatever their names (a result whose name is taken gets more
underscores).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 20
MAX_ROWS = 16_000
#: Characters of a word, as the features see it.
LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


class Stems(C.Words):
    """Two hashes for each word: of the word, and of its first five characters."""

    def spans(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, last = self.edges(x)
        starts = np.flatnonzero((x & 0xC0) != 0x80)  # of characters
        sixth = np.searchsorted(starts, first) + 5
        end = np.where(sixth < len(starts), starts[np.minimum(sixth, len(starts) - 1)], len(x)) if len(starts) else first
        return np.stack(self.hashes(x, first, last, np.minimum(end, last)), axis=1), first, last


class Featurizer:
    """Features of texts: hashes of words, stems, pairs, triples and skip-grams, by their upper bits."""

    def __init__(self, bits: int = BITS):
        self.bits, self.words = bits, Stems(LETTERS)

    def occurrences(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the text, index) of each occurrence of a feature."""
        both, n = self.words(raws)
        both = both.reshape(-1, 2)
        h, stem, of = both[:, 0], both[:, 1], np.repeat(np.arange(len(raws)), n)
        m = np.uint64(C.GOLDEN)
        parts, texts = [h, stem], [of, of]
        for seed, gap in ((1, 1), (2, 2), (3, 3)):  # next words, then skip-grams over one and two words
            one = of[:-gap] == of[gap:]
            parts.append(((h[:-gap] * m + h[gap:] + np.uint64(seed)) * np.uint64(C.MIX1))[one])
            texts.append(of[:-gap][one])
        one = of[:-2] == of[2:]
        parts.append((((h[:-2] * m + h[1:-1]) * m + h[2:] + np.uint64(4)) * np.uint64(C.MIX2))[one])
        texts.append(of[:-2][one])
        return np.concatenate(texts), (np.concatenate(parts) >> np.uint64(64 - self.bits)).astype(np.int64)

    def distinct(self, raws: list[bytes], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the text, index) of each feature of a text once, in order; only those that ``keep`` has, where it is given."""
        of, at = self.occurrences(raws)
        if keep is not None:
            some = np.flatnonzero(keep[at])
            of, at = of[some], at[some]
        both = np.unique(of << self.bits | at)
        return both >> self.bits, both & (1 << self.bits) - 1

    def __call__(self, raw: bytes) -> np.ndarray:
        """The distinct feature indices of a text, ascending."""
        return self.distinct([raw])[1]


def packed(at: np.ndarray) -> bytes:
    """Ascending indices as byte planes of their differences, compressed: the sample waits on the driver in this form."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(planes.T.copy().view("<u4").reshape(-1), dtype=np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; the weight of a coordinate is 0 unless its |z| exceeds l1."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, y: int, weight: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * weight
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


@dataclass
class Model:
    index: np.ndarray  # ascending feature indices with a weight
    weight: np.ndarray
    bias: float
    known: bool  # whether anything was learnt
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.index] = self.weight
        return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = 2, positive: float = 4.0) -> Model:
    """Fit on a bounded sample of ``labels`` (``doc_id``, ``label`` 0 or 1) and the texts of ``docs``; a row of label 1
    counts ``positive`` times, as such rows are few. The sample is drawn from the labels, so that no text is shuffled: its ids are broadcast."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).dropna()
    picked = known.select("id", "y", F.xxhash64(F.col("id").cast("string")).alias("k")).distinct().orderBy("k", "id", "y").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").select("k", F.xxhash64("text").alias("t"), "y", "text")

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer(bits)
        for b in (y for x in it for y in C.batches([x], 2 * C.SPAN)):
            at = [packed(f(x)) for x in C.utf8(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(at, pa.binary())], ["k", "t", "y", "at"])

    sample = rows.mapInArrow(C.tidied(features), "k long, t long, y int, at binary").dropDuplicates(["k", "t", "y"])
    ready, path = C.stage(sample, "labelled-features", "none")
    got = heapq.nsmallest(max_rows, ((r["k"], r["t"], r["y"], r["at"]) for r in ready.toLocalIterator()))
    C.drop_path(ready.sparkSession, path)
    if not got:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, False, bits)
    model = Ftrl(1 << bits)
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(got))
        for k in order:
            at = np.append(unpacked(got[k][3]), 1 << bits)
            model.learn(at, got[k][2], positive if got[k][2] else 1.0)
    w = model.weights(np.arange((1 << bits) + 1))
    at = np.flatnonzero(w[:-1])
    return Model(at, w[at], float(w[-1]), len(at) > 0 or w[-1] != 0, bits)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with _score (double, 0 to 1) after its own columns."""
    (name,) = C.fresh(docs.columns, "_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        f, w = Featurizer(m.bits), m.dense()
        heavy = w != 0
        for x in it:
            out = [np.zeros(0)]
            for raws in C.chunks(C.utf8(x), 2 * C.SPAN, len):
                of, at = f.distinct(raws, heavy)
                z = m.bias + np.bincount(of, w[at], len(raws))
                out.append(1 / (1 + np.exp(-np.clip(z, -35, 35))) if m.known else np.zeros(len(raws)))
            yield pa.array(np.concatenate(out))
        C.tidy()

    return docs.withColumn(name, scored(F.col(f"`{text}`")))


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out (crc32 of doc_id as text, mod 5, is not 0)."""
    return fit(docs, labels.where(C.in_train()))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit_documents(docs, C.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (C.held_remainder() == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
