"""Benchmark decontamination: Wu-Manber search for the word windows of benchmark items in documents.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and characters from U+0080 on. An item's windows are
its 13 consecutive words at each start; an item of fewer words, but not none, is one window. The symbols of the
search are words: for the windows of one length, a shift table says for each block of two words how far the search may
jump, and where it may not, a bucket by the hash of the window's last two words (its suffix) holds the windows to
compare word by word. Windows of each length have tables of their own.

Defined results: a null text has no words and is not contaminated; very long texts are searched whole; items without words match nothing; a null
item_id counts as an empty one; a window that several items share counts for each; repeated rows are searched each on their own; an empty
table gives an empty result, an empty benchmark matches nothing; other columns of the input stay, whatever their names (results whose names
are taken get more underscores).
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Each byte as the search sees it: words keep their bytes, A-Z lower-cased, all else is a blank.
WORD_BYTES = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


def windows(item: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    if not item:
        return set()
    return {tuple(item[k : k + width]) for k in range(max(1, len(item) - width + 1))}


class WuManber:
    """Search for windows of one length ``m``: shift tables over word blocks, buckets by suffix, direct comparison."""

    def __init__(self, m: int, found: dict[tuple[bytes, ...], int]):
        self.m, self.block = m, min(2, m)
        self.free = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for w, mark in found.items():
            for end in range(self.block, m + 1):
                key = w[end - 2 : end] if self.block == 2 else w[end - 1]
                self.shift[key] = min(self.shift.get(key, self.free), m - end)
            self.bucket[w[-2:] if self.block == 2 else w[-1]].append((w, mark))
        self.bucket = dict(self.bucket)

    def search(self, ws: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, mark) of each occurrence."""
        m, n, free, shift, bucket = self.m, len(ws), self.free, self.shift.get, self.bucket
        i = m - 1
        if self.block == 2:
            while i < n:
                key = (ws[i - 1], ws[i])
                jump = shift(key, free)
                if jump:
                    i += jump
                    continue
                here = tuple(ws[i - m + 1 : i + 1])
                for w, mark in bucket[key]:
                    if w == here:
                        yield i - m + 1, mark
                i += 1
        else:
            for i, x in enumerate(ws):
                for _, mark in bucket.get(x, ()):
                    yield i, mark


class Patterns:
    """Searchers for all window lengths, made on first use in each worker; a mark stands for the list of items that hold the window."""

    def __init__(self, rows: list[tuple[str, bytes]], width: int):
        self.rows, self.width = rows, width

    @functools.cached_property
    def made(self) -> tuple[list[list[str]], list[WuManber]]:
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, raw in self.rows:
            for w in windows(words(raw), self.width):
                owners[w].add(item)
        by: dict[int, dict] = defaultdict(dict)
        for k, w in enumerate(owners):
            by[len(w)][w] = k
        return [sorted(x) for x in owners.values()], [WuManber(m, x) for m, x in sorted(by.items())]

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """((start, end) of word ranges that are hit, in order and apart; the items)."""
        names, searchers = self.made
        items: set[str] = set()
        found = []
        for s in searchers:
            for at, mark in s.search(ws):
                found.append((at, at + s.m))
                items.update(names[mark])
        return joined(found), items


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


RANGES = "array<struct<a: int, b: int>>"


def mark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, max_broadcast: int = 16 << 20) -> DataFrame:
    """``docs`` with _n_words, _n_hit (long) and _items (array of item ids as strings, sorted) after its own columns.

    A broadcast holds at most ``max_broadcast`` bytes of benchmark text (a longer single item stands alone). For a larger
    benchmark, texts are read once for each group of items; each round writes the hit ranges and items of the rows that have some, and these
    are joined to the rows at the end: results are the same. ``docs`` must then be a plain read (or a staged table).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("raw"))
    size = items.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("n")).first()["n"]
    rounds = max(1, -(-int(size) // max_broadcast))

    def held(part: DataFrame):
        return spark.sparkContext.broadcast(Patterns([(r["item"], bytes(r["raw"])) for r in part.collect()], width))

    names = C.fresh(docs.columns, "_n_words", "_n_hit", "_items")
    if rounds == 1:
        return _counted(docs, text, names, held(items))
    rid, ranges, found = C.fresh([*docs.columns, *names], "rid", "ranges", "found")
    rows = C.placed(docs, rid)
    texts = rows.select(F.col(rid).alias("rid"), F.col(f"`{text}`").alias("text"))
    parts = [C.stage(_search(texts, held(items.where(F.pmod(F.xxhash64("item", "raw"), F.lit(rounds)) == k))), f"decontaminate-round{k}")[0] for k in range(rounds)]
    each = functools.reduce(DataFrame.unionByName, parts).groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias(ranges), F.flatten(F.collect_list("items")).alias(found))
    both = rows.join(each.withColumnRenamed("rid", rid), rid, "left").select(*(F.col(f"`{c}`") for c in docs.columns), ranges, found)
    return _counted(both, text, names)


def _search(rows: DataFrame, shared) -> DataFrame:
    """(rid, ranges, items) of the rows (rid, text) with hits."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [shared.value.hits(words(raw)) for raw in C.utf8(b.column(1))]
            some = [k for k, (r, _) in enumerate(got) if r]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), pa.array([[{"a": x, "b": y} for x, y in got[k][0]] for k in some], kind), pa.array([list(got[k][1]) for k in some], pa.list_(pa.string()))], ["rid", "ranges", "items"])

    return rows.mapInArrow(C.tidied(run), f"rid long, ranges {RANGES}, items array<string>")


def _counted(docs: DataFrame, text: str, names: list[str], shared=None) -> DataFrame:
    """``docs`` with the counts; without patterns, from the ranges and items in its last two columns, which go. Only texts go to Python
    and only counts come back."""

    def rows(cut: list[list[bytes]], got: list[tuple]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([len(ws) for ws in cut], pa.int64()), pa.array([sum(y - x for x, y in r) for r, _ in got], pa.int64()), pa.array([sorted(i) for _, i in got], pa.list_(pa.string()))], ["a", "b", "c"])

    @F.arrow_udf("struct<a: long, b: long, c: array<string>>")
    def searched(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in it:
            cut = [words(raw) for raw in C.utf8(x)]
            yield rows(cut, [shared.value.hits(ws) for ws in cut])
        C.tidy()

    @F.arrow_udf("struct<a: long, b: long, c: array<string>>")
    def counted(it: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, ranges, items in it:
            yield rows([words(raw) for raw in C.utf8(x)], [(joined([(y["a"], y["b"]) for y in r or ()]), set(i or ())) for r, i in zip(ranges.to_pylist(), items.to_pylist())])

    own = docs.columns if shared is not None else docs.columns[:-2]
    found = searched(F.col(f"`{text}`")) if shared is not None else counted(F.col(f"`{text}`"), *docs.columns[-2:])
    (at,) = C.fresh([*docs.columns, *names], "found")
    return docs.withColumn(at, found).select(*(F.col(f"`{c}`") for c in own), *(F.col(at)[k].alias(n) for k, n in zip("abc", names)))


def contaminated(n_words: str = "_n_words", n_hit: str = "_n_hit", share: int = 20):
    """Column: a twentieth of the words or more are hit."""
    return (F.col(n_hit) > 0) & (F.lit(share) * F.col(n_hit) >= F.col(n_words))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = mark_hits(C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce({_WORDS}, []) as ws from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as ws from benchmark where text is not null),
bw as (select distinct item, least(13, len(ws)) as m, list_slice(ws, k, k + least(13, len(ws)) - 1) as win
       from (select item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) as k from b where len(ws) > 0)),
sizes as (select distinct m from bw),
dw as (select rid, k, m, list_slice(ws, k, k + m - 1) as win
       from (select rid, m, ws, unnest(range(1, len(ws) - m + 2)) as k from d, sizes where len(ws) >= m)),
occ as (select rid, k, dw.m, item from dw join bw on dw.m = bw.m and dw.win = bw.win),
hit as (select rid, count(distinct w) as n_hit from (select rid, unnest(range(k, k + m)) as w from occ) group by rid),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from occ) group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hit using (rid) left join its using (rid)
"""
