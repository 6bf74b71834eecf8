"""What the operators of this subpackage share: shared tables, 64-bit mixing, Arrow helpers."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd constants of the splitmix64 finaliser (fixed values).
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser over uint64 values, with a seed."""
    z = x.astype(np.uint64, copy=True)
    z += np.uint64(((seed + 1) * GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    z ^= z >> np.uint64(30)
    z *= np.uint64(MIX1)
    z ^= z >> np.uint64(27)
    z *= np.uint64(MIX2)
    z ^= z >> np.uint64(31)
    return z


def below(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes mapped to 0..n-1 by their upper 32 bits (n < 2**31)."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


#: The multiplier of word hashes (odd), and its inverse.
STEP = MIX2
BACK = pow(MIX2, -1, 1 << 64)
#: Bytes that are hashed at once, about.
SPAN = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class Words:
    """Hashes of the words of many texts at once, without a step per word.

    ``letters`` maps each byte to what it counts as in a word; a byte that maps to a blank parts words. A word's hash is the sum of a random
    number for each byte times a power for its place, from running sums over all bytes, mixed with its length.
    """

    def __init__(self, letters: bytes, seed: int = 0):
        self.letters, self.seed = letters, seed
        self.number = mix64(np.arange(256, dtype=np.uint64), 500 + seed)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(uint64 hashes of all words in order, words of each text)."""
        data = b" ".join(raws).translate(self.letters)
        starts = np.cumsum([0, *(len(x) + 1 for x in raws)])
        hashes, at, low = [], [], 0
        while low < len(data):
            high = data.find(b" ", low + SPAN) if low + SPAN < len(data) else -1
            high = len(data) if high < 0 else high
            h, first, _ = self.spans(np.frombuffer(data, np.uint8, high - low, low))
            hashes.append(h)
            at.append(first + low)
            low = high
        if not at:
            return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
        return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(at), starts))

    def spans(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends) of the words in mapped bytes."""
        first, last = self.edges(x)
        return self.hashes(x, first, last)[0], first, last

    @staticmethod
    def edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the words in mapped bytes."""
        inside = np.zeros(len(x) + 2, np.int8)
        inside[1:-1] = x != 32
        edge = np.diff(inside)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def hashes(self, x: np.ndarray, first: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """For each array of ends, a hash for each of the byte ranges of ``x`` from ``first`` up to there."""
        n = len(x)
        if len(self.up) < n:
            self.up, self.down = _powers(STEP, max(n, SPAN + 4096)), _powers(BACK, max(n, SPAN + 4096))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.number[x] * self.up[:n], out=total[1:])
        out = [mix64((total[last] - total[first]) * self.down[first] + (last - first).astype(np.uint64), self.seed + k) for k, last in enumerate(ends)]
        if n > 4 * SPAN:  # a giant word: don't keep tables for it
            self.up = self.down = np.ones(1, np.uint64)
        return out


class Known:
    """Distinct 64-bit keys and arrays beside them, found again by lookups of many keys at once."""

    def __init__(self, **kinds):
        self.kinds = kinds
        self.clear()

    def clear(self) -> None:
        self.n = 0  # what is in use of the arrays, which grow by doubling
        self.keys = np.zeros(1024, np.uint64)
        self.beside = {name: np.zeros(1024, kind) for name, kind in self.kinds.items()}
        self.old = self.recent = pd.Index(self.keys[:0])  # two indexes: only the small one is made anew for each batch

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where it isn't known."""
        at = self.old.get_indexer(keys)
        left = np.flatnonzero(at < 0)
        if len(left) and len(self.recent):
            got = self.recent.get_indexer(keys[left])
            at[left] = np.where(got >= 0, got + len(self.old), -1)
        return at

    def learn(self, keys: np.ndarray, of) -> np.ndarray:
        """The place of each key. ``of`` is asked for the values of the new ones, by name, given a place in ``keys`` of each."""
        at = self.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            distinct, one, back = np.unique(keys[new], return_index=True, return_inverse=True)
            at[new] = self.n + back
            self._add(distinct, of(new[one]))
        return at

    def _add(self, keys: np.ndarray, values: dict[str, np.ndarray]) -> None:
        end = self.n + len(keys)
        if end > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros(end, np.uint64)])
            self.beside = {k: np.concatenate([x, np.zeros(end, x.dtype)]) for k, x in self.beside.items()}
        self.keys[self.n : end] = keys
        for k, x in values.items():
            self.beside[k][self.n : end] = x
        self.n = end
        if end - len(self.old) > max(50_000, len(self.old) // 16):
            self.old, self.recent = pd.Index(self.keys[:end].copy()), pd.Index(self.keys[:0])
        else:
            self.recent = pd.Index(self.keys[len(self.old) : end].copy())


class KnownIds(Known):
    """Keys with a list of ids each."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        super().__init__(first=np.int64, size=np.int32)

    def clear(self) -> None:
        super().clear()
        self.n_ids, self.ids = 0, np.zeros(4096, self.dtype)

    def hold(self, ids: list) -> dict[str, np.ndarray]:
        """Take in the lists of ids of new keys."""
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        end = self.n_ids + int(size.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(end, self.dtype)])
        self.ids[self.n_ids : end] = np.fromiter(itertools.chain.from_iterable(ids), self.dtype, end - self.n_ids)
        first = self.n_ids + np.cumsum(size) - size
        self.n_ids = end
        return {"first": first, "size": size}

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of places in turn, how many each has)."""
        size = self.beside["size"][at].astype(np.int64)
        ends = np.cumsum(size)
        place = np.repeat(self.beside["first"][at] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[place], size


def summed_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, ``counts`` of them each."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, the context's checkpoint folder, or one of our
    own if all workers run on this machine (tests); else it raises, as a cluster's machines would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc.getCheckpointDir()
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='duskveil-')}")
            found = sc.getCheckpointDir()
    return found


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the session ends."""
    path = f"{shared_dir(spark)}/duskveil/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def stage(df: DataFrame, name: str, codec: str = "zstd", partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    w = df.write.option("compression", codec)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are gone."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of rows that go to a Python worker, or come back, at once.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python are bounded by bytes too, unless the session says otherwise: texts may be very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that no column of a table has."""
    have, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def placed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row's place. Two reads of a file agree only if both split it alike, so the number of
    splits that Spark aims at, which else follows the executors there are at the moment, is held for the session."""
    spark, key = docs.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, spark.sparkContext.defaultParallelism)
    return docs.withColumn(name, F.monotonically_increasing_id())


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives b''."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def in_train(doc_id: str = "doc_id", mod: int = 5, held: int = 0):
    """Column: crc32 of the id as text leaves another remainder than the held-out one. A null id counts as 0."""
    return held_remainder(doc_id, mod) != F.lit(held)


def held_remainder(doc_id: str = "doc_id", mod: int = 5):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def chunks(values: list, limit: int, size) -> Iterator[list]:
    """Consecutive lists of values whose sizes add to at most ``limit`` (a larger value stands alone)."""
    out, total = [], 0
    for v in values:
        if out and total + size(v) > limit:
            yield out
            out, total = [], 0
        out.append(v)
        total += size(v)
    if out:
        yield out


def tidy() -> None:
    """Give a worker's free memory back to the machine: workers are kept between tasks, and hold what their allocators keep."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    pa.default_memory_pool().release_unused()


def tidied(run):
    """A function over batches that tidies up when its task ends."""

    def wrapped(it):
        try:
            yield from run(it)
        finally:
            tidy()

    return wrapped


def batches(it: Iterable[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``max_bytes`` of data each; a longer row stands alone."""
    for b in it:
        if not b.num_rows:
            continue
        per = max(1, int(b.num_rows * max_bytes / max(1, b.nbytes)))
        for k in range(0, b.num_rows, per):
            yield b.slice(k, per)


def bloom(ids: DataFrame, n: int, max_bytes: int = 8 << 20):
    """A broadcast Bloom filter of the ``n`` long ids of a one-column table, of at most ``max_bytes``.

    It only spares work: what passes goes on to an exact join, and a filter that is too full lets all pass. Its parts are
    made by tasks of about a million ids each, and have 64 bytes at least.
    """
    parts = min(max(64, -(-n // 1_000_000)), max_bytes // 64)
    bits = min(max_bytes * 8 // parts, -(-max(n, 64) * 10 // parts) + 64) // 8 * 8
    name = ids.columns[0]

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(bits, np.uint8)
        for at in _bloom_bits(pdf[name].to_numpy(), bits):
            out[at] = 1
        return pd.DataFrame({"part": [int(key[0])], "raw": [np.packbits(out, bitorder="little").tobytes()]})

    raw = np.zeros(parts * bits // 8, np.uint8)
    dealt = ids.withColumn("_part", F.pmod(name, F.lit(parts)).cast("int"))
    for r in dealt.groupBy("_part").applyInPandas(build, "part int, raw binary").toLocalIterator():
        raw[r["part"] * bits // 8 : (r["part"] + 1) * bits // 8] = np.frombuffer(r["raw"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast((raw, bits, parts))


def _bloom_bits(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [below(mix64(ids.view(np.uint64), 50 + k), bits).astype(np.int64) for k in range(5)]


def may_hold(ids: np.ndarray, bloom_filter: tuple) -> np.ndarray:
    """Which int64 ids may be in a filter of ``bloom``; all that are in it are among them."""
    raw, bits, parts = bloom_filter
    base, out = (ids % parts) * bits, np.ones(len(ids), bool)
    for at in _bloom_bits(ids, bits):
        out &= (raw[(base + at) >> 3] >> ((base + at) & 7).astype(np.uint8) & 1).astype(bool)
    return out
