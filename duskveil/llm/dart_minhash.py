"""MinHash near-dedup with dart signatures.

A text is the set of its shingles: five consecutive words, or all words of a shorter text; ``signatures`` takes weighted sets too.
Hashed darts are thrown at the regions of the elements. The weight axis of an element is cut at 1, 2, 4, ..., and the rank axis of
each such strip in cells that grow with the rank; how many darts fall in a cell (a Poisson number) and where in it follows from
hashes of the element, the strip and the cell alone. A text keeps the darts under its weights and up to a rank that gives
about ``k (ln k + 2)`` of them, whatever its total weight, and the earliest dart of each of ``k`` coordinates is its signature. Two
signatures agree in a coordinate with the probability of the (weighted) Jaccard similarity. A text that leaves a coordinate
empty throws again, up to twice the rank.

Texts with equal shingles are one class from the start. ``BANDS`` bands of ``ROWS`` coordinates make buckets. In a bucket,
nothing is paired with everything: in each round one leader (another one each round) is compared with the members that
are not in its component yet, candidates are verified on their whole shingle sets, and components are merged. What then stays apart within a
bucket is settled exactly: its members meet in blocks, with their signatures and shingle sets, only the members outside of the bucket's main
component on one side; pairs whose signatures may reach the threshold are verified there, unless the links found before
connect them already, so that a block gives fewer links than it has members. No member is left out.

Classes are the connected components of the verified links. Components, candidates and shingle sets are never
collected; shingle sets are made for one text of each set in shared buckets only, behind a Bloom filter of bounded size that precedes an exact join.

Defined results: words are those of ``decontaminate``; null, empty and wordless texts have no shingles and are copies of
each other (in ``one_of_each`` only where the texts are equal); very long texts are taken whole; repeated rows are copies; a class is named
by its smallest doc_id, a null last; an empty table gives an empty result; extra columns don't matter, whatever their names. Texts are
identified by a 64-bit hash of their shingles.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import _WORDS, WORD_BYTES

K, BANDS, ROWS = 120, 24, 5
#: Coordinates of the longer signatures that judge candidates, a byte of each.
LONG = 480
SHINGLE = 5
SIMILARITY = 0.8
ROUNDS = 3
#: Members of a bucket that meet in one block, and bytes of their shingle sets, about.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Elements or darts in hand at once.
THROW = 1 << 17


class Shingler:
    """Shingle hashes of texts."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.words = C.Words(WORD_BYTES)

    def __call__(self, raws: list[bytes]) -> list[np.ndarray]:
        """The distinct shingles of each text, as ascending uint64 hashes."""
        h, counts = self.words(raws)
        ends = np.cumsum(counts)
        whole = self._of(h, self.size, 0)
        out = []
        for n, end in zip(counts.tolist(), ends.tolist()):
            if n >= self.size:
                out.append(distinct(whole[end - n : end - self.size + 1]))
            else:
                out.append(self._of(h[end - n : end], n, n))
        return out

    @staticmethod
    def _of(h: np.ndarray, size: int, seed: int) -> np.ndarray:
        n = len(h) - size + 1
        out = np.zeros(max(0, n) if size else 0, np.uint64)
        for k in range(size if len(out) else 0):
            out = out * np.uint64(C.GOLDEN) + h[k : k + n]
        return C.mix64(out, seed)


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def cells(limit: float) -> list[tuple[float, float]]:
    """(start, width) of the rank cells below ``limit``, for a strip of weight 1: four of each width 1, 2, 4, ..."""
    out, low, width = [], 0.0, 1.0
    while low < limit:
        out.append((low, width))
        low += width
        if len(out) % 4 == 0:
            width *= 2
    return out


@functools.cache
def _poisson(mean: float) -> np.ndarray:
    """The distribution function of Poisson numbers."""
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 20))
    return np.cumsum(np.exp(k * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])))


def strips(element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strips of the weight axis that the weights reach into: (element's position, its hash, start, width)."""
    each = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    at = np.repeat(np.arange(len(element)), each)
    v = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    start = np.where(v > 0, 2.0 ** (v - 1), 0.0)
    return at, C.mix64(element[at] + v.astype(np.uint64) * np.uint64(C.MIX1), 7), start, np.maximum(start, 1.0)


def darts(element: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts of rank up to ``limit`` under the weights: (position of the element, rank, 64 random bits)."""
    at, h, start, width = strips(element, weight)
    most, got = limit[at] * width, []  # a strip of that width has its darts as much earlier
    for c, (low, size) in enumerate(cells(float(most.max(initial=0)))):
        own = np.flatnonzero(most > low)
        count = np.searchsorted(_poisson(size), (C.mix64(h[own], 2 * c + 11) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        of = np.repeat(own, count)
        nth = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        d = C.mix64(h[of] + nth * np.uint64(C.GOLDEN), 2 * c + 12)
        rank = low + size * ((d >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        height = start[of] + width[of] * ((d & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        hit = np.flatnonzero((rank <= most[of]) & (height < weight[at[of]]))
        got.append((at[of[hit]], rank[hit] / width[of[hit]], C.mix64(d[hit], 9)))
    return tuple(np.concatenate([np.zeros(0, t), *(g[k] for g in got)]) for k, t in enumerate((np.int64, np.float64, np.uint64)))  # type: ignore[return-value]


def signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = K) -> np.ndarray:
    """A row of ``k`` uint64 dart names for each set of distinct hashes; a row of zeros for an empty set.

    Darts are thrown for about ``THROW`` of them at a time, whatever the number and the sizes of the sets.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(len(sets) * k, empty)  # rank, then name: a coordinate's least number is its earliest dart
    sizes = np.array([len(s) for s in sets], np.int64)
    total = np.array([w.sum() for w in weights]) if weights else sizes
    todo, scale = np.flatnonzero(sizes), 1.0
    while len(todo):
        most = scale * k * (math.log(k) + 2)
        work = np.maximum(sizes[todo], most)
        for part in np.split(todo, np.flatnonzero(np.diff((np.cumsum(work) // THROW).astype(np.int64))) + 1):
            element = np.concatenate([sets[t] for t in part])
            weight = np.concatenate([weights[t] for t in part]).astype(np.float64) if weights else np.ones(len(element))
            owner = np.repeat(part, sizes[part])
            for x in range(0, len(element), THROW):
                own = owner[x : x + THROW]
                at, rank, bits = darts(element[x : x + THROW], weight[x : x + THROW], most / total[own])
                key = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | bits >> np.uint64(32)
                np.minimum.at(best, own[at] * k + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64), key)
        todo, scale = todo[(best.reshape(-1, k)[todo] == empty).any(1)], scale * 2
    return np.where(best == empty, np.uint64(0), (best & np.uint64(0xFFFFFFFF)) + np.uint64(1)).reshape(-1, k)


def band_keys(sigs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) of int64 bucket keys."""
    parts = sigs[:, : bands * rows].reshape(-1, bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sigs), 1))
    for k in range(rows):
        out = C.mix64(out * np.uint64(C.GOLDEN) + parts[:, :, k], 31)
    return out.view(np.int64)


def text_id(raw: bytes) -> int:
    """A signed 64-bit name of a text without words."""
    return xxhash.xxh3_64_intdigest(raw, seed=1) - (1 << 63)


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of ascending hashes."""
    return int(np.array([xxhash.xxh3_64_intdigest(shingles.tobytes())], np.uint64).view(np.int64)[0])


def sketches(docs: DataFrame, text: str = "text", by_text: bool = False) -> DataFrame:
    """``docs`` less ``text``, with cid (the set's name) and bands (array<long>: the keys of its buckets). ``by_text``:
    wordless texts are named by what they hold, not by the empty set."""
    others = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in (y for x in it for y in C.batches([x], 2 << 20)):
            raws = C.utf8(b.column(0))
            sets = shingle(raws)
            ids = [set_id(s) if len(s) or not by_text else text_id(x) for s, x in zip(sets, raws)]
            keys = band_keys(signatures(sets))
            have = np.array([len(s) > 0 for s in sets])
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(have * BANDS)]), pa.int32()), pa.array(keys[have].reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(ids, pa.int64()), bands], names=[*others, "cid", "bands"])

    return docs.select(text, *others).mapInArrow(C.tidied(run), kinds + ", cid long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int, text: str, key: str) -> DataFrame:
    """``wanted`` (cid, bands, place) with sig (a byte of each of LONG coordinates) and shingles (the ascending lower halves of the
    set's hashes). ``place``: the hash of ``key`` of some row with that set; other rows' texts are not looked at."""
    shared = C.bloom(wanted.select("place"), n)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in it:
            some = b.filter(pa.array(C.may_hold(b.column(1).to_numpy(), shared.value)))
            for part in C.batches([some], 2 << 20):
                sets = shingle(C.utf8(part.column(0)))
                sigs = (signatures(sets, k=LONG) >> np.uint64(8)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array([distinct(s.astype("<u4")).tobytes() for s in sets], pa.binary())], ["cid", "sig", "shingles"])

    rows = docs.select(F.col(text).alias("text"), F.xxhash64(key).alias("place"))
    found = rows.mapInArrow(C.tidied(run), "cid long, sig binary, shingles binary").groupBy("cid").agg(F.first("sig").alias("sig"), F.first("shingles").alias("shingles"))
    return wanted.drop("place").join(found, "cid")


def least_agreement() -> int:
    """Of LONG coordinates, how many agree at least for sets of the wanted similarity: five deviations below the mean."""
    return int(LONG * SIMILARITY - 5 * math.sqrt(LONG * SIMILARITY * (1 - SIMILARITY)))


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose long signatures may belong to sets of the wanted similarity."""
    least = least_agreement()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, LONG) for k in (2, 3))
            ok = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    one, two = (sets.select(F.col("cid").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(C.tidied(run), "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets, each ascending, have that Jaccard similarity or more."""
    least = similarity / (1 + similarity) * (len(x) + len(y)) - 1e-9  # of common elements
    if min(len(x), len(y)) < least:
        return False
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum()) >= least


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose shingle sets are similar."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (y for x in it for y in C.batches([x], 8 << 20)):
            ok = pa.array([similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    one, two = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(C.tidied(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cid, root): the smallest id of each connected component of (a, b); by large and small stars in turn."""
    now, path = C.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after, new = C.stage(small.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        C.drop_path(now.sparkSession, path)
        now, path = after, new
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.count_distinct("u").alias("d")).first()
        if (r["n"], r["h"]) == state:
            break
        state = (r["n"], r["h"])
    return now.select(F.col("u").alias("cid"), F.col("v").alias("root"))


def link_sets(docs: DataFrame, sketched: DataFrame, text: str, key: str) -> DataFrame:
    """(cid, root) for the sets that have links to others; ``sketched``: the sketches of ``docs``, with ``key`` among their columns."""
    spark = docs.sparkSession
    each, _ = C.stage(sketched.groupBy("cid").agg(F.first("bands").alias("bands"), F.xxhash64(F.min(key)).alias("place")), "sets")
    rows = each.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members, _ = C.stage(rows.join(shared, "key").select("key", "band", "cid"), "buckets")
    wanted, _ = C.stage(members.select("cid").distinct().join(each, "cid"), "wanted")
    C.release_shuffles(spark)
    sets, _ = C.stage(shingle_sets(docs, wanted, wanted.count(), text, key), "shingle-sets")
    buckets = members.select("key", "cid")
    root = None
    for k in range(ROUNDS):
        turn = F.lit(int(C.mix64(np.array([k], np.uint64), 77).view(np.int64)[0]))
        now = _with_root(buckets, root)
        lead = now.groupBy("key").agg(F.min(F.col("cid").bitwiseXOR(turn)).alias("x"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", F.col("x").bitwiseXOR(turn).alias("a"))
        pairs = now.join(lead, "key").where("a <> cid").select("a", F.col("cid").alias("b"), F.col("root").alias("rb")).distinct()
        pairs = _with_root(pairs.withColumnRenamed("a", "cid"), root, "ra").where("ra <> rb").select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b")).distinct()
        root = _merge(verified(likely(pairs, sets), sets), root)
        C.release_shuffles(spark)
    return _merge(_rest(members, root, sets), root)


def _with_root(rows: DataFrame, root: DataFrame | None, name: str = "root") -> DataFrame:
    if root is None:
        return rows.withColumn(name, F.col("cid"))
    return rows.join(root.withColumnRenamed("root", "_r"), "cid", "left").withColumn(name, F.coalesce("_r", "cid")).drop("_r")


def _merge(links: DataFrame, root: DataFrame | None) -> DataFrame:
    if root is not None:
        links = links.unionByName(root.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    return components(links)


def _rest(members: DataFrame, root: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect what still stays apart in a bucket: members meet in blocks, with signatures and shingle sets."""
    now = _with_root(members, root)
    mixed = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    now, _ = C.stage(now.join(mixed, "key").join(sets, "cid"), "mixed")
    sizes = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("shingles")).alias("size"))
    main, _ = C.stage(sizes.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.greatest(F.sum("c") / BLOCK, F.sum("size") / BLOCK_BYTES).alias("blocks")), "main")
    now = now.join(main, "key").withColumn("block", F.pmod(F.xxhash64("cid"), F.ceil("blocks")).cast("int")).withColumn("light", F.col("root") != F.col("main"))
    pack = F.collect_list(F.struct("cid", "root", "sig", "bands", "shingles"))
    every = now.groupBy("key", "block").agg(pack.alias("rows")).drop("block")
    light = now.where("light").groupBy("key", "block").agg(F.first("band").alias("band"), F.first("main").alias("main"), pack.alias("lights")).drop("block")
    least = least_agreement()

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, 1) for b in it for k in range(b.num_rows)):
            ((band, main, one, two),) = zip(*(b.column(k).to_pylist() for k in range(4)))
            x, y = (np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(-1, LONG) for rows in (one, two))
            cx, cy, rx, ry = (np.array([r[c] for r in rows], np.int64) for c in ("cid", "root") for rows in (one, two))
            bx, by = (np.array([r["bands"][:band] for r in rows], np.int64).reshape(len(rows), -1) for rows in (one, two))
            parent: dict[int, int] = {}

            def find(r: int) -> int:
                while (up := parent.get(r, r)) != r:
                    parent[r] = r = parent.get(up, up)
                return r

            found = []
            for k in range(len(x)):
                # two light members meet twice, and those of an earlier common bucket have met there
                new = (ry != rx[k]) & ((ry == main) | (cy > cx[k])) & ~(by == bx[k]).any(1)
                at = np.flatnonzero(new)
                mine = np.frombuffer(one[k]["shingles"], "<u4")
                for j in at[(x[k] == y[at]).sum(1) >= least].tolist():
                    p, q = find(int(rx[k])), find(int(ry[j]))
                    if p != q and similar(mine, np.frombuffer(two[j]["shingles"], "<u4")):
                        parent[p] = q
                        found.append((min(cx[k], cy[j]), max(cx[k], cy[j])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return light.join(every, "key").select("band", "main", "lights", "rows").mapInArrow(C.tidied(meet), "a long, b long").distinct()


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", by_text: bool = False) -> DataFrame:
    """``docs`` less ``text``, with ``root`` (long): the same for all rows of a class of near copies. ``key``: a column that tells most rows apart."""
    sketched, _ = C.stage(sketches(docs, text, by_text), "sketches")
    C.release_shuffles(docs.sparkSession)
    root = link_sets(docs, sketched, text, key)
    return _with_root(sketched.drop("bands"), root).drop("cid")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and class_size for every row."""
    rows = classes(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows, _ = C.stage(rows, "classes")
    named, _ = C.stage(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "class-names")
    return rows.join(named, "root").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest doc_id (a null last), the first in the
    table of equal ones. Wordless texts are copies only where they are equal. Rows are known by their place in the table, so ``docs``
    must be a plain read (or a staged table)."""
    rid, maybe_gone = C.fresh(docs.columns, "rid", "maybe")
    rows = C.placed(docs, rid)
    found, _ = C.stage(classes(rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(rid).alias("rid")), by_text=True), "classes")
    best, _ = C.stage(found.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("stays")).where("n > 1"), "class-heads")
    gone, _ = C.stage(found.join(best, "root").where("rid <> stays").select("rid"), "copies")
    shared = C.bloom(gone, gone.count())

    @F.pandas_udf("boolean")
    def maybe(x):
        return pd.Series(C.may_hold(x.to_numpy(), shared.value))

    flagged = rows.withColumn(maybe_gone, maybe(rid))
    kept = flagged.where(~F.col(maybe_gone)).unionByName(flagged.where(maybe_gone).join(gone.withColumnRenamed("rid", rid), rid, "left_anti"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


OP2_SQL = f"""
with recursive d as (select row_number() over () as rid, doc_id, coalesce({_WORDS}, []) as ws from documents),
s as (select distinct rid, sh from (select rid, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda k: array_to_string(list_slice(ws, k, k + 4), ' ')) end) as sh from d)),
n as (select rid, count(*) as c from s group by rid),
p as (select a.rid as x, b.rid as y, count(*) as same from s a join s b on a.sh = b.sh and a.rid <> b.rid group by a.rid, b.rid),
l as (select x, y from p join n a on x = a.rid join n b on y = b.rid where same >= 0.8 * (a.c + b.c - same) - 1e-9
      union select a.rid, b.rid from d a, (select min(rid) as rid from d where len(ws) = 0) b where len(a.ws) = 0
      union select b.rid, a.rid from d a, (select min(rid) as rid from d where len(ws) = 0) b where len(a.ws) = 0),
r(x, y) as (select rid, rid from d union select r.x, l.y from r join l on r.y = l.x)
select any_value(a.doc_id) as doc_id, min(b.doc_id) as class_id, count(*) as class_size from r join d a on r.x = a.rid join d b on r.y = b.rid group by r.x
"""
