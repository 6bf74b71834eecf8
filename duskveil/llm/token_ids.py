"""Token ids as binary files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Texts are encoded with the tokenizers library. The ids are ranked by their frequency in the whole corpus, so that
frequent ids have small ranks; a rank is stored in 1 to 4 bytes, and its length less one in two bits of a control
stream of its own (four ids a control byte). A table of 256 rows gives, for each control byte, the lengths of its four
ids, so that numpy decodes a whole block by lookups.

The files are Parquet; a row is a block of documents in ascending doc_id order:
shard, block (int), first (long: ids of the shard before the block), n (long: ids in the block), doc_ids (int64, little endian), nulls (uint8: the
id is null), sizes (uint32: ids of each document), control (bytes), data (bytes). ``ranks`` beside them holds
(rank, id, n); of equally frequent ids the smaller one ranks first.

Defined results: a null or empty text has the end id alone; very long texts are encoded whole, in a block of their own; a null doc_id comes first; equal
doc_ids stay apart, ordered by content; repeated rows are documents of their own; an empty table gives empty files; extra columns don't matter.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The number of bytes of each of the four ids that a control byte describes.
LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + 1
#: Ids in a block, about; a longer document stands alone.
BLOCK_IDS = 1 << 18
#: Pieces that a worker remembers, before it starts anew.
MEMO = 2_500_000
#: ASCII characters that are neither letters, digits nor white space.
MARKS = "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum())
#: White space outside of ASCII, as UTF-8 (fixed values: the characters with the White_Space property).
WIDE_SPACES = tuple(chr(x).encode() for x in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of uint32 ranks."""
    n = len(ranks)
    padded = np.zeros(-(-n // 4) * 4, np.uint32)
    padded[:n] = ranks
    size = 1 + (padded >= 1 << 8) + (padded >= 1 << 16) + (padded >= 1 << 24)
    codes = (size - 1).astype(np.uint8).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    keep = np.arange(4) < size[:n, None]
    return control.tobytes(), padded[:n].astype("<u4").view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The uint32 ranks of a block: lengths by table lookup, then one gather for each byte position."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    start = np.cumsum(size) - size
    out = raw[start].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        long = np.flatnonzero(size > k)
        out[long] |= raw[start[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Encoder:
    """Ids of whole texts, through the tokenizers library.

    The tokenizer's own rules split a text at white space before anything else, and its normaliser acts on each piece
    alone (``splits_at_space`` verifies this against the definition); so each distinct piece is encoded once and
    remembered. Pieces are told apart by 64-bit hashes, made for all bytes of a batch at once; only new ones are looked at one by one. A
    piece of Latin-1 letters and then, maybe, ASCII marks is two runs to the rules, in any case of letters; such a run of letters goes straight to the
    library's merge model. Another kind of tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self.by_piece = splits_at_space(path)
        self.words = C.Words(bytes(32 if 9 <= x <= 13 else x for x in range(256)))
        self.pieces = C.KnownIds(self.dtype)
        self.marks: dict[str, list[int]] = {"": []}
        self.model = self.tokenizer.model
        self.shown = byte_letters()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pieces, none of which holds white space."""
        out: list = [None] * len(pieces)
        others, tokenize, shown = [], self.model.tokenize, self.shown
        for k, p in enumerate(pieces):
            core = p.rstrip(MARKS)
            if not core.isalpha() or max(core) > "\u00ff":
                others.append(k)
                continue
            tail = self.marks.get(p[len(core) :])
            if tail is None:
                if len(self.marks) > 10_000:
                    self.marks = {"": []}
                tail = self.marks[p[len(core) :]] = self._encode([p[len(core) :]])[0]
            word = core.lower()
            out[k] = [t.id for t in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(shown))] + tail
        for k, ids in zip(others, self._encode([pieces[k] for k in others])):
            out[k] = ids
        return out

    def encode(self, raws: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in turn, how many each text has), with ``end_id`` after each text."""
        if not self.by_piece:
            each = [x + ([] if end_id is None else [end_id]) for x in self._encode([x.decode() for x in raws])]
            return np.fromiter(itertools.chain.from_iterable(each), self.dtype), np.array([len(x) for x in each], np.int64)
        if self.pieces.n > MEMO:
            self.pieces.clear()
        ids, sizes = [], []
        for part in C.chunks(raws, 2 * C.SPAN, len):
            a, b = self._batch(part, end_id)
            ids.append(a)
            sizes.append(b)
        return np.concatenate(ids or [np.zeros(0, self.dtype)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def _batch(self, raws: list[bytes], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        data = b" ".join(raws)
        if any(x in data for x in WIDE_SPACES):
            raws = [functools.reduce(lambda r, x: r.replace(x, b" "), WIDE_SPACES, raw) for raw in raws]
            data = b" ".join(raws)
        keys, first, last = self.words.spans(np.frombuffer(data.translate(self.words.letters), np.uint8))
        at = self.pieces.learn(keys, lambda new: self.pieces.hold(self._learn([data[a:b].decode() for a, b in zip(first[new].tolist(), last[new].tolist())])))
        flat, size = self.pieces.gather(at)
        starts = np.cumsum([0, *(len(x) + 1 for x in raws)])
        bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(first, starts)]
        if end_id is not None:
            flat = np.insert(flat, bounds[1:], end_id)
        return flat, np.diff(bounds) + (end_id is not None)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else one from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in plain)}


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker process's encoder: what it has learnt serves all its tasks."""
    return Encoder(path)


def splits_at_space(path: str) -> bool:
    """Whether the file's rules drop white space and encode what lies between as if it stood alone."""
    rules = json.load(open(path, encoding="utf-8"))
    steps = (rules.get("normalizer") or {}).get("normalizers", [])
    pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    drops = bool(pre) and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and pre[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in rules.get("added_tokens", []))
    bytewise = len(pre) == 2 and pre[1]["type"] == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex", True)
    return plain and drops and added and bytewise and rules["model"]["type"] == "BPE" and not rules.get("post_processor")


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = None) -> DataFrame:
    """(doc_id long, ids binary): the ids of each whole text as little-endian integers of the encoder's width."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(path)
        for b in (y for x in it for y in C.batches([x], 4 << 20)):
            flat, sizes = enc.encode(C.utf8(b.column(1)), end_id)
            ends = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes) * enc.dtype.itemsize]).astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends, pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), ids], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(C.tidied(run), "doc_id long, ids binary")


def write_token_files(docs: DataFrame, path: str, to: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = None, shards: int | None = None) -> None:
    """Encode ``docs`` and write the files under ``to``: blocks and ranks.

    Encoding runs once: ids go to a staged table; one pass over that counts ids (at most a row for each id of the
    vocabulary and task), and one shuffle by doc_id ranges puts them in order. Only the rank table, as long as the
    vocabulary, reaches the driver and the workers.
    """
    spark = docs.sparkSession
    ids, staged = C.stage(encoded(docs, path, doc_id, text, end_id), "token-ids")
    enc = encoder(path)
    width, vocab = enc.dtype.itemsize, max(enc.vocab, (end_id or 0) + 1)
    kind = f"<u{width}"

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for b in it:
            total += np.bincount(np.frombuffer(b"".join(x or b"" for x in b.column(0).to_pylist()), kind), minlength=vocab)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["id", "n"])

    counted = ids.select("ids").mapInArrow(C.tidied(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counted = counted.sort_values(["n", "id"], ascending=[False, True], ignore_index=True)
    rank = np.zeros(vocab, np.uint32)
    rank[counted["id"].to_numpy()] = np.arange(len(counted), dtype=np.uint32)
    counted["rank"] = np.arange(len(counted))
    spark.createDataFrame([tuple(map(int, r)) for r in counted[["rank", "id", "n"]].itertuples(index=False)], "rank long, id long, n long").coalesce(1).write.mode("overwrite").parquet(f"{to}/ranks")
    to_rank = spark.sparkContext.broadcast(rank)

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, block = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush():
            sizes = np.array([len(x) // width for _, x in held], "<u4")
            control, data = encode_ranks(to_rank.value[np.frombuffer(b"".join(x for _, x in held), kind)])
            row = [shard, block, first, size, np.array([d or 0 for d, _ in held], "<i8").tobytes(), bytes(d is None for d, _ in held), sizes.tobytes(), control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["shard", "block", "first", "n", "doc_ids", "nulls", "sizes", "control", "data"])

        for b in it:
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((d, raw or b""))
                size += len(held[-1][1]) // width
                if size >= BLOCK_IDS:
                    yield flush()
                    first, block, held, size = first + size, block + 1, [], 0
        if held:
            yield flush()

    shards = shards or max(1, ids.rdd.getNumPartitions())
    # the hash beside doc_id keeps repeated doc_ids from meeting in one range when their texts differ
    placed = ids.withColumn("_tie", F.xxhash64("ids")).repartitionByRange(shards, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "ids")
    placed.mapInArrow(C.tidied(blocks), "shard int, block int, first long, n long, doc_ids binary, nulls binary, sizes binary, control binary, data binary").write.mode("overwrite").option("compression", "none").parquet(f"{to}/blocks")
    C.drop_path(spark, staged)


def read_token_files(spark, at: str) -> DataFrame:
    """(doc_id long, start long, ids binary of little-endian uint32), decoded from the files under ``at``."""
    to_id = _ids_by_rank(spark, at)
    blocks = spark.read.parquet(f"{at}/blocks")
    starts = spark.sparkContext.broadcast(_shard_starts(blocks))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                docs, sizes, ids, start = decode_block(row, to_id.value, starts.value)
                ends = np.cumsum(sizes)
                raw = [ids[e - n : e].tobytes() for e, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(raw, pa.binary())], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(C.tidied(run), "doc_id long, start long, ids binary")


def _ids_by_rank(spark, at: str):
    ranks = spark.read.parquet(f"{at}/ranks").orderBy("rank").toPandas()  # as long as the vocabulary
    return spark.sparkContext.broadcast(ranks["id"].to_numpy().astype("<u4"))


def _shard_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids of all shards before each one: a number for each shard."""
    out, total = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():
        out[r["shard"]] = total
        total += r["n"]
    return out


def decode_block(row: dict, to_id: np.ndarray, starts: dict[int, int]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
    ids = to_id[decode_ranks(row["control"], row["data"], int(sizes.sum()))]
    docs = [None if null else d for d, null in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["nulls"])]
    return docs, sizes, ids, starts[row["shard"]] + row["first"] + np.cumsum(sizes) - sizes


def token_digests(spark, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files under ``at``."""
    to_id = _ids_by_rank(spark, at)
    blocks = spark.read.parquet(f"{at}/blocks")
    starts = spark.sparkContext.broadcast(_shard_starts(blocks))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                docs, sizes, ids, start = decode_block(row, to_id.value, starts.value)
                raw, ends = memoryview(ids.tobytes()), (4 * np.cumsum(sizes)).tolist()
                crc = [zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends, sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(C.tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark, sf_dir: str) -> DataFrame:
    to = C.new_path(spark, "token-files")
    write_token_files(C.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), to, end_id=1)
    C.release_shuffles(spark)
    return token_digests(spark, to)
