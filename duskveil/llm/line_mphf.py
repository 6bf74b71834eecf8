"""Line dedup: lines found in many documents go, by probes of sharded minimal perfect hashes.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. The document frequency
of each key is counted over all documents (partial counts in each task, one shuffle of hash and count). The keys
that reach the threshold are dealt to shards by hash; a shard holds a minimal perfect hash, the whole 64-bit hash and
a count for each of its keys, so that a rarer line is told apart by all 64 bits. Documents probe these arrays; lines are never joined.

Defined results: a null or empty text is one empty line; an empty key never goes; a key that repeats within one
document counts once; very long texts and lines are taken whole; repeated rows are documents of their own; an empty table gives an empty
result; other columns of the input stay, whatever their names (results whose names are taken get more underscores).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LEVELS = 40


class Mphf:
    """A minimal perfect hash of distinct uint64 keys: at each level, keys that are alone in their slot settle."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], rest: np.ndarray):
        self.levels, self.rest = levels, rest

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> Mphf:
        levels, left, settled = [], np.asarray(keys, np.uint64), 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-int(gamma * len(left) + 64) // 64) * 64
            at = C.below(C.mix64(left, level), size).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            ranks = settled + np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]])
            levels.append((size, words, ranks.astype(np.uint32)))
            settled += int(alone.sum())
            left = left[~alone]
        return cls(levels, np.sort(left))  # what 40 levels leave: practically nothing

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not built in, some slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, left, settled = np.arange(len(keys)), np.asarray(keys, np.uint64), 0
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = C.below(C.mix64(left, level), size)
            w, b = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            word = words[w]
            hit = ((word >> b) & np.uint64(1)).astype(bool)
            before = np.bitwise_count(word & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (ranks[w].astype(np.int64) + before)[hit]
            settled = int(ranks[-1]) + int(np.bitwise_count(words[-1]))
            todo, left = todo[~hit], left[~hit]
        if len(self.rest) and len(left):
            k = np.searchsorted(self.rest, left)
            same = (k < len(self.rest)) & (self.rest[np.minimum(k, len(self.rest) - 1)] == left)
            out[todo[same]] = settled + k[same]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *(s for s, _, _ in self.levels)], np.int64).tobytes()
        return head + b"".join(w.tobytes() + r.tobytes() for _, w, r in self.levels) + self.rest.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Mphf:
        n, rest = np.frombuffer(raw, np.int64, 2)
        sizes, at, levels = np.frombuffer(raw, np.int64, int(n), 16), 16 + 8 * int(n), []
        for size in sizes.tolist():
            words = np.frombuffer(raw, np.uint64, size // 64, at)
            ranks = np.frombuffer(raw, np.uint32, size // 64, at + size // 8)
            at += size // 8 + size // 16
            levels.append((size, words, ranks))
        return cls(levels, np.frombuffer(raw, np.uint64, int(rest), at))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return C.below(C.mix64(keys, 1001), shards).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """What tells a shard's keys from others: all bits of the key."""
    return np.asarray(keys, np.uint64)


class Shards:
    """Some of the shards: from a key to its count, 0 for keys that none of them has."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]], shards: int):
        self.shards = shards
        self.by = {s: (Mphf.from_bytes(m), np.frombuffer(f, np.uint64), np.frombuffer(c, np.uint32)) for s, m, f, c in rows}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        at, prints = shard_of(keys, self.shards), fingerprint(keys)
        for s, (mphf, fp, count) in self.by.items():
            own = np.flatnonzero(at == s)
            if not len(own) or not len(fp):
                continue
            k = mphf.index(keys[own])
            ok = (k >= 0) & (k < len(fp))
            ok[ok] = fp[k[ok]] == prints[own[ok]]
            out[own[ok]] = count[k[ok]]
        return out


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each line's key; 0 stands for the empty key."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(k) or 1 if (k := x.strip().lower()) else 0 for x in lines), np.uint64, len(lines))


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h long, n long): the number of documents that hold each non-empty line key."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for b in it:
            for raw in C.utf8(b.column(0)):
                h = np.unique(line_hashes(raw.split(b"\n")))
                held.append(h[h != 0])
                size += len(h)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select(text).mapInArrow(C.tidied(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def build_shards(counts: DataFrame, n_keys: int, keys_per_shard: int) -> tuple[DataFrame, int]:
    """A row for each shard: (shard, mphf, prints, counts). A shard holds about ``keys_per_shard`` keys."""
    shards = max(1, -(-n_keys // keys_per_shard))

    def build(key, pdf):
        import pandas as pd

        keys = pdf["h"].to_numpy().view(np.uint64)
        mphf = Mphf.build(keys)
        at = mphf.index(keys)
        prints, n = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32)
        prints[at] = fingerprint(keys)
        n[at] = np.minimum(pdf["n"].to_numpy(), 0xFFFFFFFF)
        return pd.DataFrame({"shard": [key[0]], "mphf": [mphf.to_bytes()], "prints": [prints.tobytes()], "counts": [n.tobytes()]})

    @F.pandas_udf("int")
    def shard(h):
        import pandas as pd

        return pd.Series(shard_of(h.to_numpy().view(np.uint64), shards).astype(np.int32))

    dealt = counts.withColumn("shard", shard("h"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, mphf binary, prints binary, counts binary"), shards


def drop_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, keys_per_shard: int = 1_000_000, max_broadcast: int = 64 << 20) -> DataFrame:
    """``docs`` with ``text`` freed of frequent lines, and with _n_lines and _n_dropped (long) after its own columns.

    A broadcast holds at most ``max_broadcast`` bytes of shards (a single shard has about 14 bytes for each of its
    ``keys_per_shard`` keys). Where all shards together are larger, texts are read once for each group of shards; each round writes
    the places of its lines for rows that have some, and these are joined to the rows at the end: results are the same. ``docs``
    must then be a plain read (or a staged table).
    """
    spark = docs.sparkSession
    frequent, path = C.stage(line_counts(docs, text).where(F.col("n") >= min_docs), "lines")
    built, shards = build_shards(frequent, frequent.count(), keys_per_shard)
    built, _ = C.stage(built, "line-shards")
    C.drop_path(spark, path)
    sizes = built.select("shard", (F.length("mphf") + F.length("prints") + F.length("counts")).alias("size")).collect()
    groups = [[r["shard"] for r in g] for g in C.chunks(sorted(sizes), max_broadcast, lambda r: r["size"])] or [[]]

    def held(group: list[int]):
        return spark.sparkContext.broadcast([tuple(r) for r in built.where(F.col("shard").isin(group)).select("shard", "mphf", "prints", "counts").collect()] if group else [])

    names = C.fresh(docs.columns, "_n_lines", "_n_dropped")
    if len(groups) == 1:
        return _cut(docs, text, names, shared=held(groups[0]), shards=shards, min_docs=min_docs)
    rid, gone = C.fresh([*docs.columns, *names], "rid", "gone")
    rows = C.placed(docs, rid)
    found = [C.stage(_found(rows.select(F.col(rid).alias("rid"), F.col(f"`{text}`").alias("text")), held(g), shards, min_docs), "line-places")[0] for g in groups]
    each = functools.reduce(DataFrame.unionByName, found).groupBy("rid").agg(F.flatten(F.collect_list("places")).alias(gone)).withColumnRenamed("rid", rid)
    return _cut(rows.join(each, rid, "left").select(*(F.col(f"`{c}`") for c in docs.columns), gone), text, names)


def _found(rows: DataFrame, shared, shards: int, min_docs: int) -> DataFrame:
    """(rid, places): the places of lines that these shards hold, for the rows (rid, text) that have some."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shards(shared.value, shards)
        for b in (y for x in it for y in C.batches([x], 32 << 20)):
            out = [np.flatnonzero(g) for g in _frequent([x.split(b"\n") for x in C.utf8(b.column(1))], held, min_docs)]
            some = [k for k, x in enumerate(out) if len(x)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), pa.array([out[k].astype(np.int32) for k in some], pa.list_(pa.int32()))], ["rid", "places"])

    return rows.mapInArrow(C.tidied(run), "rid long, places array<int>")


def _frequent(texts: list[list[bytes]], held: Shards, min_docs: int) -> list[np.ndarray]:
    """For each text, which of its lines go."""
    keys = line_hashes([y for x in texts for y in x])
    gone = (held.counts(keys) >= min_docs) & (keys != 0)
    return np.split(gone, np.cumsum([len(x) for x in texts])[:-1])


def _cut(docs: DataFrame, text: str, names: list[str], shared=None, shards: int = 0, min_docs: int = 0) -> DataFrame:
    """``docs`` less the lines that the shards hold; without shards, less those whose places are in the last column, which goes."""
    at, fields = docs.columns.index(text), docs.schema.fields
    own = fields if shared is not None else fields[:-1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if shared is None else Shards(shared.value, shards)
        for b in (y for x in it for y in C.batches([x], 32 << 20)):
            texts = [x.split(b"\n") for x in C.utf8(b.column(at))]
            if held is not None:
                gone = _frequent(texts, held, min_docs)
            else:
                gone = [np.zeros(len(x), bool) for x in texts]
                for g, places in zip(gone, b.column(len(own)).to_pylist()):
                    g[places or []] = True
            nulls, kept = b.column(at).is_null().to_pylist(), []
            for x, g, null in zip(texts, gone, nulls):
                kept.append(None if null else b"\n".join([y for y, z in zip(x, g.tolist()) if not z] if g.any() else x))
            new = pa.array(kept, pa.binary()).cast(b.schema.field(at).type)
            columns = [new if k == at else b.column(k) for k in range(len(own))]
            counts = [pa.array([len(x) for x in texts], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*(f.name for f in own), *names])

    return docs.mapInArrow(C.tidied(run), T.StructType([*own, *(T.StructField(n, T.LongType()) for n in names)]))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def digest(kept: str) -> str:
    return hashlib.sha256(kept.encode()).hexdigest()


OP7_SQL = """
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
l as (select rid, doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key as fkey from k where length(key) >= 1 group by key having count(distinct rid) >= 10)
select doc_id, count(*) as n_lines, count(fkey) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where fkey is null), '')) as kept_sha256
from k left join f on key = fkey group by rid, doc_id
"""
