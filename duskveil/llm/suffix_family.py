"""Suffix-array dedup: a logarithmic family of suffix arrays finds long matches; repeated 100-byte strings go.

Sampled suffixes. Of each 100-byte string of a document, the 24-byte string with the smallest hash (the first of these) is the
anchor. Equal strings have equal anchors at equal places, so a suffix is sampled where it starts at an anchor: about
one in 39. All strings with the same anchor make its extent, of 100 to 176 bytes. A suffix array here is a sorted list of sampled
suffixes, by their first 24 bytes and then by a 64-bit hash of the extent, each with the place of its first occurrence; it is dealt to shards by a
hash of the 24 bytes, and sorted within a shard.

The family. Documents come in batches in ascending doc_id order. A batch gets its suffix arrays, which are merge-scanned
against all levels for long matches. Two suffixes with equal 24 bytes and equal extents are a match of the whole extent: the later one's bytes
go. Suffixes with equal 24 bytes and different extents may match in part: the first occurrence of each such extent is handed on. The
batch's new suffixes become a level, and levels of equal size are merged to one of twice the size. Levels lie in a folder of their own;
with ``at``, they stay there, and a later session can open the family and append to it.

Matches in part. The extents that were handed on are read from the documents (a Bloom filter of bounded size picks them; what it lets
through in error changes nothing), those with one anchor meet, and their strings are compared in the order of their documents: each but the
earliest is repeated. Bytes under repeated strings go. So copies cost a number for each anchor, no group is ever paired with itself, and an
anchor with very many extents has its strings dealt out one by one.

What counts as equal: whole extents by 24 bytes and 64 bits of hash, strings in part by their bytes, strings that are dealt out one by one by
128 bits of hash.

Defined results: a null or empty text has no bytes; a text under 100 bytes stays; very long texts are taken whole; documents are ordered by
doc_id (a null first), equal doc_ids by their place in the table; strings are judged on the input; an empty table gives an empty
result; extra columns don't matter. Rows are known by their place in the table, so ``docs`` must be a plain read (or a staged table).
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 100
KEY = 24
SPAN = LENGTH - KEY + 1  # key starts within a string
BATCHES = 4
CHUNK = 1 << 20
PLACE_BITS = 24  # of a key's place in a chunk, under its hash
BLOOM = 32 << 20
#: Extents of one anchor that may meet in one task; the strings of larger groups are dealt one by one.
LARGE = 4_000
#: Suffixes that a task sorts at once: so many, or more if there are many shards to deal them to.
FLUSH, FLUSH_MOST = 300_000, 3_000_000


def key_hash(k0: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 24 bytes, given as three numbers."""
    h = k0 * np.uint64(C.GOLDEN)
    h += k1
    h *= np.uint64(C.MIX1)
    h += k2
    h ^= h >> np.uint64(31)
    h *= np.uint64(C.MIX2)
    h ^= h >> np.uint64(29)
    return h


class Sample:
    """The anchors of the documents of a chunk."""

    def __init__(self, raws: list[bytes]):
        self.raw = b"".join(raws) + bytes(KEY + 8)
        n = len(self.raw) - KEY - 8
        sizes = np.array([len(x) for x in raws], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        empty = np.zeros(0, np.int64)
        self.doc = self.first = self.last = self.anchor = empty
        self.word = np.ndarray((n + KEY - 8 + 1,), ">u8", self.raw, strides=(1,))
        if n < LENGTH:
            return
        w = self.word.astype(np.uint64)
        self.hash = key_hash(w[:-16], w[8:-8], w[16:])[:n]
        if n >= 1 << PLACE_BITS:
            place, keep = np.uint64((1 << 32) - 1), np.uint64(0xFFFFFFFF00000000)  # a single document this long
        else:
            place, keep = np.uint64((1 << PLACE_BITS) - 1), np.uint64(~((1 << PLACE_BITS) - 1) & 0xFFFFFFFFFFFFFFFF)
        low = (self.hash & keep) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
        valid = np.zeros(n + 1, np.int8)
        long = sizes >= LENGTH
        np.add.at(valid, self.starts[long], 1)
        np.add.at(valid, self.ends[long] - LENGTH + 1, -1)
        at = np.flatnonzero(np.cumsum(valid, dtype=np.int8)[:n])  # where a string starts that lies in one document
        if not len(at):
            return
        a = (low[at] & place).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.anchor = a[new]
        self.first = at[new]  # the first and the last start of a string with that anchor
        self.last = at[np.append(new[1:], len(at)) - 1]
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def keys(self) -> np.ndarray:
        """(anchors, 3) uint64: the anchors' first 24 bytes, so that numbers sort as bytes do."""
        return np.stack([self.word[self.anchor + k].astype(np.uint64) for k in (0, 8, 16)], axis=1) if len(self.anchor) else np.zeros((0, 3), np.uint64)

    def names(self) -> np.ndarray:
        """A 64-bit hash of each anchor's first 24 bytes."""
        return self.hash[self.anchor] if len(self.anchor) else np.zeros(0, np.uint64)


#: An entry of a suffix array: 24 bytes of the suffix as three numbers, the extent's hash, and where it first occurs: the row, its doc_id (0 in
#: levels, which come before any batch), the start of the extent's first string, how many more strings it has.
ENTRY = np.dtype([("k0", "<u8"), ("k1", "<u8"), ("k2", "<u8"), ("x", "<u8"), ("rid", "<i8"), ("doc", "<i8"), ("first", "<u4"), ("more", "u1")])
#: A byte range of a row, from the start of its first string, with how many more strings follow.
MARK = np.dtype([("rid", "<i8"), ("first", "<u4"), ("more", "u1")])


def entry_names(x: np.ndarray) -> np.ndarray:
    """The names of entries: the hash that chooses anchors."""
    return key_hash(x["k0"].copy(), x["k1"].copy(), x["k2"].copy())


def pack(x: np.ndarray) -> bytes:
    """Entries or marks as byte planes, the first numbers as differences."""
    x, name = x.copy(), x.dtype.names[0]
    x[name] = np.diff(x[name], prepend=x[name].dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def unpack(raw: bytes, kind: np.dtype = ENTRY) -> np.ndarray:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(kind.itemsize, -1).T.copy(order="C").reshape(-1).view(kind)
    x[kind.names[0]] = np.cumsum(x[kind.names[0]], dtype=kind[0])
    return x


def joined(arrays: list[np.ndarray], kind: np.dtype = ENTRY) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


def marks_of(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), MARK)
    for name in MARK.names:
        out[name] = x[name]
    return out


def ordering(x: np.ndarray, *then: str) -> np.ndarray:
    """The order of the entries by suffix, extent and the other fields named. Most differ in their first eight bytes; only the others are
    sorted by all."""
    order = np.argsort(x["k0"], kind="stable")
    k = x["k0"][order]
    same = k[1:] == k[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(k) else np.zeros(0, np.int64)
    if len(tied):
        y = x[order[tied]]
        order[tied] = order[tied][np.lexsort([y[n] for n in reversed(("k0", "k1", "k2", "x", *then))])]
    return order


def ordered(x: np.ndarray) -> np.ndarray:
    return x[ordering(x, "doc", "rid", "first")]


def begins(x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """Where a sorted array has another value of these than before."""
    new = np.ones(len(x), bool)
    if len(x):
        new[1:] = np.logical_or.reduce([x[n][1:] != x[n][:-1] for n in names])
    return new


SUFFIX, CLASS = ("k0", "k1", "k2"), ("k0", "k1", "k2", "x")


def classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first occurrence of each suffix and extent, sorted; the marks of all later ones)."""
    x = ordered(x)
    new = begins(x, CLASS)
    return x[new], marks_of(x[~new])


def scan(batch: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge-scan of a batch's classes against those of the levels, which come before: (the batch's new classes; marks of those that a
    level has: matches of whole extents; the first occurrences that may match in part, each once over all batches)."""
    x = joined([batch, *levels])
    old = np.arange(len(x)) >= len(batch)
    x["doc"] = old  # a level's entry goes after the batch's equal one
    order = ordering(x, "doc")
    x, old = x[order], old[order]
    again = np.zeros(len(x), bool)
    again[:-1] = ~begins(x, CLASS)[1:]  # the next one is equal: the level's
    again &= ~old
    group = np.cumsum(begins(x, SUFFIX)) - 1
    fresh = ~old & ~again
    n_old, n_new = (np.bincount(group[w], minlength=int(group[-1]) + 1 if len(group) else 0) for w in (old, fresh))
    meets = (n_new > 0) & (n_old + n_new > 1)
    part = fresh & meets[group] | old & (meets & (n_old == 1))[group]  # two or more old ones have been handed on before
    x["doc"] = 0
    return x[fresh], marks_of(x[again]), x[part]


class Family:
    """The levels: each a table of (shard, packed suffix array), with a size of 1, 2, 4, ... batches. ``at``: a folder to stay in."""

    def __init__(self, spark, shards: int, at: str | None = None):
        self.spark, self.shards, self.at = spark, shards, at
        self.levels: list[tuple[int, DataFrame, str]] = []

    @classmethod
    def open(cls, spark, at: str) -> Family:
        """A family that ``save`` has left in that folder."""
        rows = spark.read.parquet(f"{at}/levels").orderBy("place").collect()
        out = cls(spark, rows[0]["shards"], at)
        out.levels = [(r["size"], spark.read.schema("shard int, packed binary").parquet(r["path"]), r["path"]) for r in rows if r["size"]]
        return out

    def save(self) -> None:
        """Note which levels there are, for ``open``; the folders of merged ones go."""
        rows = [(-1, self.shards, 0, ""), *((k, self.shards, n, path) for k, (n, _, path) in enumerate(self.levels))]
        self.spark.createDataFrame(rows, "place int, shards int, size int, path string").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/levels")

    def _stage(self, rows: DataFrame) -> tuple[DataFrame, str]:
        if self.at is None:
            return C.stage(rows, "suffix-level", "none")
        path = f"{self.at}/level-{uuid.uuid4().hex[:12]}"
        rows.write.option("compression", "none").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def suffixes(self, rows: DataFrame) -> DataFrame:
        """(shard, packed, marks): the suffix arrays of each task's rows (rid, doc_id, text), and what already recurs in the task."""
        shards = self.shards
        most = min(max(FLUSH, 100 * shards), FLUSH_MOST)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def flush():
                x, marks = classes(joined(held))
                shard = C.below(C.mix64(entry_names(x), 3), shards).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                bounds = np.searchsorted(shard[order], np.arange(shards + 1))
                own = [k for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
                parts = np.array_split(marks, len(own)) if own else []  # any shard can carry them
                return pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array([pack(x[order[bounds[k] : bounds[k + 1]]]) for k in own], pa.binary()), pa.array([pack(m) for m in parts], pa.binary())], ["shard", "packed", "marks"]
                )

            for b in (y for x in it for y in C.batches([x], CHUNK)):
                held.append(entries(b))
                size += len(held[-1])
                if size > most:
                    yield flush()
                    held, size = [], 0
            if size:
                yield flush()

        return rows.select("rid", "doc_id", "text").mapInArrow(C.tidied(run), "shard int, packed binary, marks binary")

    def append(self, rows: DataFrame) -> DataFrame:
        """Take in a batch of rows (rid: a number of their own among all batches, doc_id, text): (marks, parts) of each shard, packed: the
        matches of whole extents, and the first occurrences of extents, of this batch or before, that may match in part."""
        self.merge()
        every = self.suffixes(rows).withColumn("level", F.lit(-1))
        for k, (_, level, _) in enumerate(self.levels):
            every = every.unionByName(level.select("shard", "packed", F.lit(None).cast("binary").alias("marks"), F.lit(k).alias("level")))

        def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf["level"] < 0
            batch, marks = classes(joined([unpack(x) for x in pdf.loc[own, "packed"]]))
            new, whole, part = scan(batch, [unpack(x) for x in pdf.loc[~own, "packed"]])
            marks = joined([marks, whole, *(unpack(x, MARK) for x in pdf.loc[own, "marks"])], MARK)
            marks = marks[np.argsort(marks["rid"], kind="stable")]
            return pd.DataFrame({"shard": [int(key[0])], "marks": [pack(marks)], "parts": [place_name(part["rid"], part["first"]).tobytes()], "packed": [pack(new)]})

        met, path = self._stage(every.groupBy("shard").applyInPandas(meet, "shard int, marks binary, parts binary, packed binary"))
        found, _ = C.stage(met.select("marks", "parts"), "suffix-matches", "none")
        self.levels.append((1, met.select("shard", "packed"), path))
        return found

    def merge(self) -> None:
        """Merge levels of equal size, the newest first. It runs before a batch comes in."""

        def both(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [int(key[0])], "packed": [pack(ordered(joined([unpack(x) for x in pdf["packed"]])))]})

        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a, old), (_, b, new) = self.levels[-2:]
            level, path = self._stage(a.unionByName(b).groupBy("shard").applyInPandas(both, "shard int, packed binary"))
            self.levels[-2:] = [(2 * n, level, path)]
            for x in (old, new):
                C.drop_path(self.spark, x)

    def drop(self) -> None:
        for _, _, path in self.levels:
            C.drop_path(self.spark, path)
        self.levels = []


def entries(b: pa.RecordBatch) -> np.ndarray:
    """The sampled suffixes of some rows (rid, doc_id, text)."""
    s = Sample(C.utf8(b.column(2)))
    x, h = np.zeros(len(s.anchor), ENTRY), xxhash.xxh3_64_intdigest
    keys = s.keys()
    x["k0"], x["k1"], x["k2"] = keys[:, 0], keys[:, 1], keys[:, 2]
    raw = s.raw
    x["x"] = np.fromiter((h(raw[i : j + LENGTH], seed=a - i) for i, j, a in zip(s.first.tolist(), s.last.tolist(), s.anchor.tolist())), np.uint64, len(x))
    x["rid"] = b.column(0).to_numpy()[s.doc]
    x["doc"] = np.array([-(2**63) if d is None else d for d in b.column(1).to_pylist()], np.int64)[s.doc]
    x["first"], x["more"] = s.first - s.starts[s.doc], s.last - s.first
    return x


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return C.placed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "rid").select("rid", "doc_id", "text")


def contexts(rows: DataFrame, wanted) -> DataFrame:
    """The extents of which hash(rid, first) may be wanted: (name, rid, doc_id, first, bytes)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (y for x in it for y in C.batches([x], CHUNK)):
            s = Sample(C.utf8(b.column(2)))
            rid = np.array(b.column(0).to_pylist(), np.int64)[s.doc]
            first = s.first - s.starts[s.doc]
            k = np.flatnonzero(C.may_hold(place_name(rid, first), wanted.value))
            raw, take = s.raw, pa.array(s.doc[k])
            got = [raw[i : j + LENGTH] for i, j in zip(s.first[k].tolist(), s.last[k].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.names()[k].view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(first[k].astype(np.int32)), pa.array(got, pa.binary())],
                ["name", "rid", "doc_id", "first", "bytes"],
            )

    return rows.mapInArrow(C.tidied(run), "name long, rid long, doc_id long, first int, bytes binary")


MARKS = "rid long, first int, end int"


def repeated_strings(found: DataFrame, shards: int) -> DataFrame:
    """Ranges under strings of extents that an earlier extent of the same anchor holds too. Extents are dealt by their
    anchors' names, so equal strings meet; a shard goes through its extents in the order of their documents."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "rid", "first"], na_position="first", kind="stable")
        h, raws, names = xxhash.xxh3_64_intdigest, pdf["bytes"].tolist(), pdf["name"].tolist()
        sizes = np.array([len(r) - LENGTH + 1 for r in raws], np.int64)
        seeds = [n & 0xFFFFFFFFFFFFFFFF for n in names]
        strings = np.fromiter((h(r[i : i + LENGTH], seed=n) for r, n in zip(raws, seeds) for i in range(len(r) - LENGTH + 1)), np.uint64, int(sizes.sum()))
        _, one, back = np.unique(strings, return_index=True, return_inverse=True)
        earliest = one[back]
        again = earliest != np.arange(len(strings))
        owner = np.repeat(np.arange(len(raws)), sizes)
        at = np.arange(len(strings)) - (np.cumsum(sizes) - sizes)[owner]
        for k, e in zip(np.flatnonzero(again).tolist(), earliest[again].tolist()):
            if raws[owner[k]][at[k] : at[k] + LENGTH] != raws[owner[e]][at[e] : at[e] + LENGTH]:
                again = _again(raws)
                break
        return _ranges(again, sizes, pdf["rid"].to_numpy(), pdf["first"].to_numpy())

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, MARKS)


def _again(raws: list[bytes]) -> np.ndarray:
    """Which strings have occurred before, without hashes."""
    seen: set[bytes] = set()
    out = []
    for r in raws:
        for i in range(len(r) - LENGTH + 1):
            w = r[i : i + LENGTH]
            out.append(w in seen)
            seen.add(w)
    return np.array(out, bool)


def _ranges(again: np.ndarray, sizes: np.ndarray, rid: np.ndarray, first: np.ndarray) -> pd.DataFrame:
    """Runs of repeated strings within each extent as byte ranges of its document."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(again)) - (np.cumsum(sizes) - sizes)[owner]
    k = np.flatnonzero(again)
    new = np.append(True, (np.diff(k) > 1) | (owner[k[1:]] != owner[k[:-1]])) if len(k) else np.zeros(0, bool)
    start, stop = k[new], k[np.append(new[1:], True)] if len(k) else k
    begin = first[owner[start]]
    return pd.DataFrame({"rid": rid[owner[start]], "first": (begin + at[start]).astype(np.int32), "end": (begin + at[stop] + LENGTH).astype(np.int32)})


def repeated_in_large_groups(found: DataFrame) -> DataFrame:
    """The same for anchors with very many extents: each string is a row, dealt by its own hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (y for x in it for y in C.batches([x], 1 << 20)):
            raws = b.column(4).to_pylist()
            sizes = np.array([len(r) - LENGTH + 1 for r in raws], np.int64)
            h = xxhash.xxh3_128_digest
            w = np.frombuffer(b"".join([h(r[i : i + LENGTH]) for r in raws for i in range(len(r) - LENGTH + 1)]), "<i8").reshape(-1, 2)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + np.array(b.column(3).to_pylist(), np.int64)[owner]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), b.column(1).take(take), b.column(2).take(take), pa.array(at.astype(np.int32))], ["w1", "w2", "rid", "doc_id", "at"])

    strings = found.select("name", "rid", "doc_id", "first", "bytes").mapInArrow(C.tidied(run), "w1 long, w2 long, rid long, doc_id long, at int")
    spot = F.struct("doc_id", "rid", "at")
    earliest, _ = C.stage(strings.groupBy("w1", "w2").agg(F.min(spot).alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1"), "earliest")
    return strings.join(earliest, ["w1", "w2"]).where(~spot.eqNullSafe(F.col("one"))).select("rid", F.col("at").alias("first"), (F.col("at") + LENGTH).alias("end"))


def place_name(rid: np.ndarray, at: np.ndarray) -> np.ndarray:
    return C.mix64(rid.astype(np.uint64) * np.uint64(C.GOLDEN) + at.astype(np.uint64), 8).view(np.int64)


def batches_of(docs: DataFrame, doc_id: str, n: int) -> list[DataFrame]:
    """``docs`` in ``n`` ranges of doc_id, ascending; a null is in the first."""
    cuts = [] if n < 2 else sorted(set(docs.select(F.col(doc_id).cast("double").alias("d")).approxQuantile("d", [k / n for k in range(1, n)], 0.02)))
    number, out = F.col(doc_id).cast("double"), []
    for low, high in zip([None, *cuts], [*cuts, None]):
        keep = F.lit(True) if high is None else F.col(doc_id) < F.lit(int(high))
        keep = keep & (F.col(doc_id) >= F.lit(int(low))) if low is not None else keep | number.isNull()
        out.append(docs.where(keep))
    return out


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(rid, first int, end int): byte ranges under repeated strings (they may overlap); rid as ``numbered`` gives it."""
    spark = docs.sparkSession
    rows = numbered(docs, doc_id, text)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    family, found = Family(spark, shards), []
    for part in batches_of(rows, "doc_id", batches):
        found.append(family.append(part))
        C.release_shuffles(spark)
    family.drop()
    return matched(functools.reduce(DataFrame.unionByName, found), rows, shards)


def matched(found: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """(rid, first, end): byte ranges under repeated strings. ``found``: what the family's scans have given; ``rows`` (rid, doc_id, text): all
    rows that it has seen."""
    spark = rows.sparkSession

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for raw in b.column(0).to_pylist():
                x = unpack(raw, MARK)
                first = x["first"].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x["rid"]), pa.array(first), pa.array(first + x["more"] + LENGTH, pa.int32())], ["rid", "first", "end"])

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for raw in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<i8"))], ["place"])

    size = found.agg(F.coalesce(F.sum(F.length("parts")), F.lit(0)).alias("n")).first()["n"] // 8
    wanted = C.bloom(found.select("parts").mapInArrow(places, "place long"), size, BLOOM)
    extents, _ = C.stage(contexts(rows, wanted), "contexts")
    large = extents.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > LARGE).select("name")
    some = repeated_strings(extents.join(large, "name", "left_anti"), shards)
    more = repeated_in_large_groups(extents.join(large, "name", "left_semi"))
    marks, _ = C.stage(found.select("marks").mapInArrow(whole, MARKS).unionByName(some).unionByName(more), "repeats")
    C.release_shuffles(spark)
    return marks


def runs(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """For every row: doc_id, n_bytes, spans (array of struct<start, end>: what goes, in bytes), kept (binary)."""
    marks = repeats(docs, doc_id, text, batches)
    rows = numbered(docs, doc_id, text)
    touched = marks.select("rid").distinct()
    shared = C.bloom(touched, touched.count(), BLOOM)

    @F.pandas_udf("boolean")
    def maybe(rid):
        return pd.Series(C.may_hold(rid.to_numpy(), shared.value))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in (y for x in it for y in C.batches([x], CHUNK)):
            spans, kept, sizes = [], [], []
            for raw, ranges in zip(C.utf8(b.column(1)), b.column(2).to_pylist()):
                gone = runs([(r["first"], r["end"]) for r in ranges or ()])
                stay = list(zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(raw)]))
                kept.append(b"".join(raw[x:y] for x, y in stay) if gone else raw)
                spans.append([{"start": x, "end": y} for x, y in gone])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    result = "doc_id long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary"
    flagged = rows.withColumn("maybe", maybe("rid"))
    empty = F.lit(None).cast("array<struct<first: int, end: int>>").alias("ranges")
    plain = flagged.where(~F.col("maybe")).select("doc_id", "text", empty)
    ranges = marks.groupBy("rid").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))
    marked = flagged.where("maybe").join(ranges, "rid", "left").select("doc_id", "text", "ranges")
    return plain.mapInArrow(cut, result).unionByName(marked.mapInArrow(cut, result))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(C.table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


OP5_SQL = """
with d as (select row_number() over (order by doc_id nulls first) as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select rid, i, substr(h, cast(2 * i + 1 as bigint), 200) as s from (select rid, h, unnest(range(0, len(h) // 2 - 99)) as i from d)),
m as (select rid, i, row_number() over (partition by s order by rid, i) as nth from w),
g as (select rid, i from m where nth > 1),
j as (select rid, i, coalesce(i - lag(i) over (partition by rid order by i) > 100, true) as new from g),
k as (select rid, i, sum(cast(new as int)) over (partition by rid order by i) as run from j),
u as (select rid, run, min(i) as a, max(i) + 100 as b from k group by rid, run),
q as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as before, row_number() over (partition by rid order by a desc) = 1 as final from u),
kept as (select q.rid, sum(b - a) as removed, count(*) as spans, string_agg(substr(h, cast(2 * before + 1 as bigint), cast(2 * (a - before) as bigint)) || case when final then substr(h, cast(2 * b + 1 as bigint)) else '' end, '' order by a) as x
         from q join d using (rid) group by q.rid)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(x, h))) as kept_sha256
from d left join kept using (rid)
"""
