"""Media columns: payloads stored as 8-bit samples, cut by content and deduplicated by chunk digests.

The media of a payload is a WAV file: 8-bit mono samples at 8 kHz, a sample for each payload byte. A gear hash rolls
over the media's bytes; a chunk ends where its upper bits are 0, but not before ``MIN`` and at ``MAX`` bytes at the
latest. A chunk is named by its digest. Spark joins deduplicate: of all media that hold a chunk, the one with the
smallest hash lends it, and the others refer to it. The store has a row for each distinct media: the ordered digests
(the recipe), and the compressed bytes of the chunks that it holds itself. Media that occur once and share no chunk are
written where they are read; the bytes of others cross the network once on the way into the store, and on the way out only the chunks
that some other media lends do.

Reading joins referred chunks to their recipes, rebuilds the media, and verifies every chunk digest and the media's own
hash; a mismatch raises.

Defined results: a null or empty text is 192 blanks; equal texts share one media; repeated rows stay rows; an empty table
gives an empty store; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UNIT = 192
MIN, MEAN_BITS, MAX = 1024, 12, 16384
HEADER = 44
RATE = 8000
DIGEST = 16
#: The gear of each byte value, made by rule.
GEAR = (C.mix64(np.arange(256, dtype=np.uint64), 4) >> np.uint64(32)).astype(np.uint32)
STORE = "media binary, recipe binary, held array<binary>, blobs array<binary>, lent array<binary>, missing array<binary>"


def payload(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)


def to_wav(samples: bytes) -> bytes:
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def from_wav(media: bytes) -> bytes:
    riff, _, wave, _, _, kind, channels, _, _, _, bits, _, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, kind, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or len(media) != HEADER + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[HEADER:]


def gear_hits(data: bytes) -> np.ndarray:
    """Positions after which the gear hash of the last 32 bytes has MEAN_BITS leading zeros."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # a window of 2k bytes from two of k bytes
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)
    return np.flatnonzero(h < np.uint32(1 << (32 - MEAN_BITS))) + 1


def cut_all(medias: list[bytes]) -> list[list[bytes]]:
    """The chunks of each media. The hash runs over all at once: no cut comes so early that it saw another media."""
    hits, at, out = gear_hits(b"".join(medias)), 0, []
    bounds = np.searchsorted(hits, np.cumsum([0, *map(len, medias)])).tolist()
    hits = hits.tolist()
    for k, m in enumerate(medias):
        n, last, parts = len(m), 0, []
        for x in hits[bounds[k] : bounds[k + 1]]:
            x -= at
            while x - last > MAX:
                parts.append(m[last : last + MAX])
                last += MAX
            if x - last >= MIN and x < n:
                parts.append(m[last:x])
                last = x
        while n - last > MAX:
            parts.append(m[last : last + MAX])
            last += MAX
        parts.append(m[last:])
        out.append(parts)
        at += n
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:DIGEST]


def features(samples: bytes) -> str:
    """Sample count, sum, sum of squares, zero crossings and peak of the centred samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    up = x >= 0
    return f"n={len(x)};sum={int(x.sum(dtype=np.int64))};energy={int((x.astype(np.int32) ** 2).sum(dtype=np.int64))};crossings={int((up[1:] != up[:-1]).sum())};peak={int(np.abs(x).max())}"


def _medias(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes], list[list[bytes]]]]:
    for part in C.batches([b], 4 << 20):
        raws = C.utf8(part.column(column))
        medias = [to_wav(payload(x)) for x in raws]
        yield part, raws, medias, cut_all(medias)


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes long, media binary: its sha256, recipe binary: the chunk digests in order) for every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, raws, medias, cut in _medias(b, 1):
                sha = [hashlib.sha256(m).digest() for m in medias]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raws], pa.int64()), pa.array(sha, pa.binary()), pa.array([b"".join(map(digest, x)) for x in cut], pa.binary())], ["doc_id", "n_bytes", "media", "recipe"])

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(C.tidied(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, recipe binary")


def sharing(table: DataFrame) -> DataFrame:
    """(media, missing, lent: arrays of digests) for media that refer to another's chunks, or lend some."""

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            media, part = [], []
            for m, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {r[k : k + DIGEST] for k in range(0, len(r), DIGEST)}
                media += [m] * len(own)
                part += sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), pa.array(part, pa.binary())], ["media", "digest"])

    each = table.select("media", "recipe").dropDuplicates(["media"]).mapInArrow(C.tidied(split), "media binary, digest binary")
    owner = each.groupBy("digest").agg(F.min("media").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "owner")
    missing = each.join(owner, "digest").where("media <> owner").select("media", F.col("digest").alias("missing"), F.lit(None).cast("binary").alias("lent"))
    lent = owner.select(F.col("owner").alias("media"), F.lit(None).cast("binary").alias("missing"), F.col("digest").alias("lent"))
    return missing.unionByName(lent).groupBy("media").agg(F.collect_list("missing").alias("missing"), F.collect_list("lent").alias("lent"))


def train_dictionary(docs: DataFrame, text: str = "text", rows: int = 2000, size: int = 112_640) -> bytes:
    """A compression dictionary from a bounded sample: the first 4096 characters of ``rows`` texts. Results don't depend on it."""
    import zstandard

    sample = [r[0].encode() for r in docs.select(F.substring(F.col(text), 1, 4096)).where(F.length(text) > 0).limit(rows).collect()]
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def media_ids(names: list[bytes]) -> np.ndarray:
    """The first eight bytes of each media's hash."""
    return np.frombuffer(b"".join(x[:8] for x in names), "<i8")


def involved(column: DataFrame, shared: DataFrame):
    """A Bloom filter of bounded size of the media that occur again, lend or refer: all others hold their own chunks."""

    def ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(media_ids(b.column(0).to_pylist()))], ["id"])

    again = column.groupBy("media").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("media")
    known, _ = C.stage(again.unionByName(shared.select("media")).distinct().mapInArrow(ids, "id long"), "media-involved")
    return C.bloom(known, known.count(), 32 << 20)


def write_store(docs: DataFrame, shared: DataFrame, some, to: str, dictionary: bytes, text: str = "text", level: int = 9) -> None:
    """Write the store under ``to``: a row for each distinct media. ``some``: the filter of ``involved``; what it lets
    pass is gathered by media and joined to ``shared``, all else is written where it was read."""

    def press(pick: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
            for b in it:
                for _, _, medias, cut in _medias(b, 0):
                    names = [hashlib.sha256(m).digest() for m in medias]
                    mine = C.may_hold(media_ids(names), some.value) == pick
                    seen: set[bytes] = set()
                    rows = []
                    for k in np.flatnonzero(mine).tolist():
                        if names[k] not in seen:
                            seen.add(names[k])
                            digests = [digest(x) for x in cut[k]]
                            own = dict(zip(digests, cut[k]))
                            rows.append((names[k], b"".join(digests), list(own), [press.compress(x) for x in own.values()], [], []))
                    kinds = [pa.binary(), pa.binary(), *[pa.list_(pa.binary())] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["media", "recipe", "held", "blobs", "lent", "missing"])

        return docs.select(text).mapInArrow(C.tidied(run), STORE)

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without the chunks that another media lends."""
        for b in (y for x in it for y in C.batches([x], 4 << 20)):
            held, blobs = [], []
            missing = [x or [] for x in b.column(4).to_pylist()]
            for names, data, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), missing):
                stay = [k for k, x in enumerate(names) if x not in gone] if gone else range(len(names))
                held.append([names[k] for k in stay])
                blobs.append([data[k] for k in stay])
            kind = pa.list_(pa.binary())
            lent = [x or [] for x in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, kind) for x in (held, blobs, lent, missing))], ["media", "recipe", "held", "blobs", "lent", "missing"])

    once = press(True).groupBy("media").agg(*(F.first(c).alias(c) for c in ("recipe", "held", "blobs")))
    gathered = once.join(shared, "media", "left").select("media", "recipe", "held", "blobs", "missing", "lent").mapInArrow(C.tidied(keep), STORE)
    press(False).unionByName(gathered).write.option("compression", "none").parquet(to)


def read_store(spark, at: str, dictionary: bytes) -> DataFrame:
    """(media binary, wav binary) of every distinct media, rebuilt and verified."""
    store = spark.read.parquet(at)
    kind = "media binary, recipe binary, held array<binary>, blobs array<binary>"
    whole = store.where(F.size("missing") == 0).select("media", "recipe", "held", "blobs")
    lent = store.where(F.size("lent") > 0).select(F.explode(F.arrays_zip("held", "blobs")).alias("x"), "lent").where(F.array_contains("lent", F.col("x.held"))).select(F.col("x.held").alias("digest"), F.col("x.blobs").alias("blob"))
    short = store.where(F.size("missing") > 0)
    fetched = short.select("media", F.explode("missing").alias("digest")).join(lent, "digest").groupBy("media").agg(F.collect_list(F.struct("digest", "blob")).alias("got"))
    filled = short.join(fetched, "media", "left").select(
        "media", "recipe", F.concat("held", F.coalesce(F.col("got.digest"), F.array())).alias("held"), F.concat("blobs", F.coalesce(F.col("got.blob"), F.array())).alias("blobs")
    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for b in (y for x in it for y in C.batches([x], 4 << 20)):
            wavs = []
            for sha, recipe, names, data in zip(*(b.column(k).to_pylist() for k in range(4))):
                parts = {n: press.decompress(x) for n, x in zip(names, data)}
                if any(digest(x) != n for n, x in parts.items()):
                    raise ValueError("a chunk differs from its digest")
                wav = b"".join(parts[recipe[k : k + DIGEST]] for k in range(0, len(recipe), DIGEST))
                if hashlib.sha256(wav).digest() != sha:
                    raise ValueError("a media differs from its hash")
                wavs.append(wav)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wavs, pa.binary())], ["media", "wav"])

    return whole.mapInArrow(C.tidied(run), "media binary, wav binary").unionByName(filled.select(*(c.split()[0] for c in kind.split(", "))).mapInArrow(C.tidied(run), "media binary, wav binary"))


def media_features(medias: DataFrame) -> DataFrame:
    """Features and digests of (media, wav) rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (y for x in it for y in C.batches([x], 8 << 20)):
            wavs = b.column(1).to_pylist()
            samples = [from_wav(x) for x in wavs]
            sha = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
            size = lambda rows: pa.array([len(x) for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size(samples), sha(samples), pa.array([zlib.crc32(x[-16:]) for x in samples], pa.int64()), size(wavs), sha(wavs), pa.array([features(x) for x in samples], pa.string())], ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return medias.mapInArrow(C.tidied(run), "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, bytes]:
    """Write the media of ``docs``; (the media column: doc_id, n_bytes, media; the store's path; its dictionary)."""
    spark = docs.sparkSession
    column, _ = C.stage(recipes(docs, doc_id, text), "media-column")
    shared, _ = C.stage(sharing(column), "media-sharing")
    dictionary, to = train_dictionary(docs, text), C.new_path(spark, "media-store")
    C.release_shuffles(spark)
    write_store(docs, shared, involved(column, shared), to, dictionary, text)
    return column.select("doc_id", "n_bytes", "media"), to, dictionary


def op4_media_chunks(spark, sf_dir: str) -> DataFrame:
    column, at, dictionary = store_documents(C.table(spark, sf_dir, "documents"))
    C.release_shuffles(spark)
    found = media_features(read_store(spark, at, dictionary))
    return column.join(found, "media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
