"""SentencePiece models encoded and decoded by the tokenizers library.

The model file (a protobuf) is parsed here: pieces with scores and kinds, the trainer's and the normaliser's settings.
From these a tokenizers model is rebuilt: Unigram from the scores, or BPE with merges ranked by the scores of what they
make; the normaliser (precompiled character map, white space), the metaspace marker, byte fallback, and the decoder. Encoding runs
multithreaded over batches of distinct segments: a segment ends before a blank that follows another character, and around line ends, where no
piece of the vocabulary reaches across (checked on load; else texts are encoded whole). Segments are told apart by 64-bit hashes, made for
all bytes of a batch at once. Whole texts' ids are decoded by the library. Parity with the sentencepiece library can be verified text by
text, as op9 does for every document.

A run of two or more markers is the one thing the library's merges can't say: their pieces have equal scores, and the model then takes the
leftmost; ``Merger`` follows the model's own order there.

Defined results: a null or empty text has no tokens; very long texts are encoded whole; byte fallback keeps characters outside the
vocabulary; decoding gives the normalised text (a marker character in the text comes back as a blank); repeated rows are encoded each on
their own; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
#: Kinds of pieces and of models in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Segments that a worker remembers, before it starts anew.
MEMO = 400_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) pairs of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            x = raw[at]
            at += 1
            out |= (x & 127) << shift
            if x < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = raw[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


@dataclass
class ModelFile:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_prefix: bool = True
    squeeze: bool = True  # remove extra white space
    escape: bool = True

    @classmethod
    def load(cls, path: str) -> ModelFile:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, raw: bytes) -> ModelFile:
        m = cls()
        for number, value in _fields(raw):
            if number == 1:
                got = dict(_fields(value))  # type: ignore[arg-type]
                m.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got.get(2, bytes(4)))[0], got.get(3, NORMAL)))
            elif number == 2:
                got = dict(_fields(value))  # type: ignore[arg-type]
                m.kind, m.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
            elif number == 3:
                got = dict(_fields(value))  # type: ignore[arg-type]
                m.charsmap = got.get(2, b"")
                m.add_prefix, m.squeeze, m.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
        return m

    @property
    def unk(self) -> int:
        return next(k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def separable(self) -> bool:
        """No piece reaches from another character into a marker, or over a line end."""
        inner = re.compile(f"[^{MARK}]{MARK}|\n")
        return self.escape and not any(inner.search(p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def build(m: ModelFile):
    """The tokenizers model, with normaliser (less the marker before a text) and decoder."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    if m.kind == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk, m.byte_fallback))
    elif m.kind == BPE:
        ids = {p: k for k, (p, _, _) in enumerate(m.pieces)}
        joins = {p for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = [(-s, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, s, kind in m.pieces if kind == NORMAL for k in range(1, len(p)) if p[:k] in joins and p[k:] in joins]
        t = Tokenizer(models.BPE(ids, [(a, b) for *_, a, b in sorted(merges)], unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    else:
        raise ValueError(f"models of kind {m.kind} are not supported")
    user = [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED]
    if user:
        t.add_tokens(user)
    t.normalizer = normalizer(m, prefix=False)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * m.add_prefix)
    return t


def normalizer(m: ModelFile, prefix: bool = True):
    """The normaliser as tokenizers steps; without ``prefix``, no marker is put before."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if m.add_prefix and prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    return normalizers.Sequence(steps)


class Merger:
    """BPE ids of a segment by the model's own order: highest score first, then leftmost.

    Merge ranks say the same but for pieces of equal scores, which the runs of markers have.
    """

    def __init__(self, m: ModelFile):
        self.model, self.ids = m, {p: k for k, (p, _, _) in enumerate(m.pieces)}
        self.joins = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER_DEFINED)}

    def __call__(self, segment: str) -> list[int]:
        parts: list[str | None] = list(segment)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(parts) and (s := self.joins.get(w := parts[a] + parts[b])) is not None:  # type: ignore[operator]
                heapq.heappush(heap, (-s, a, w, b))

        for k in range(len(parts)):
            offer(k)
        while heap:
            _, a, w, b = heapq.heappop(heap)
            if parts[a] is None or after[a] != b or parts[b] is None or parts[a] + parts[b] != w:  # type: ignore[operator]
                continue
            parts[a], parts[b] = w, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out: list[int] = []
        for w in parts:
            if w is not None:
                out += [self.ids[w]] if w in self.joins else [self.ids[f"<0x{x:02X}>"] for x in w.encode()] if self.model.byte_fallback else [self.model.unk]
        return out


class Codec:
    """Encode and decode whole texts; distinct segments are remembered."""

    def __init__(self, path: str, threads: int = 2):
        self.threads = threads
        self._parallel()
        self.model = ModelFile.load(path)
        self.steps = normalizer(self.model)
        #: The normaliser acts on each segment alone, and no piece crosses segments.
        self.by_segment = self.model.separable() and not self.model.charsmap and not self.model.squeeze
        self.known = C.KnownIds(np.dtype("<u4"))
        self.hasher = C.Words(bytes(range(256)))
        self.merge = Merger(self.model)
        self.line_end = self.merge.ids.get("<0x0A>")

    def _parallel(self) -> None:
        """Workers are reused, and other operators may have set this otherwise."""
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(self.threads)

    @functools.cached_property
    def tokenizer(self):
        return build(self.model)

    def cut(self, raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(the texts' bytes, starts and ends of all segments, how many each text has); segments hold blanks for markers."""
        mark = MARK.encode()
        texts = [(b" " * self.model.add_prefix + (x.replace(mark, b" ") if mark in x else x)) if x else b"" for x in raws]
        data = b"\n".join(texts) + b"\n"
        x = np.frombuffer(data, np.uint8)
        line, blank = x == 10, x == 32
        start = line.copy()
        start[0] = True
        start[1:] |= line[:-1] | blank[1:] & ~blank[:-1]
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(x))
        between = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]) - 1)  # the line ends that part texts
        keep = np.ones(len(first), bool)
        keep[between] = False
        return data, first[keep], last[keep], np.diff(between, prepend=-1) - 1

    def batches(self, raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]]:
        """(hashes of segments, segments of each text, what gives the segments themselves by their places) for some texts at a time."""
        for part in C.chunks(raws, 2 * C.SPAN, len):
            data, first, last, n = self.cut(part)
            texts = lambda at, data=data, first=first, last=last: [data[a:b].decode() for a, b in zip(first[at].tolist(), last[at].tolist())]
            yield self.hasher.hashes(np.frombuffer(data, np.uint8), first, last)[0], n, texts

    def places(self, keys: np.ndarray, texts: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Where ``known`` has the segments with these hashes, after it has learnt the new ones."""
        if self.known.n > MEMO:
            self.known.clear()
        return self.known.learn(keys, lambda new: self.known.hold(self.ids_of(texts(new))))

    def encode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in turn, how many each text has)."""
        self._parallel()
        if not self.by_segment:
            each = self.tokenizer.encode_batch_fast([self.steps.normalize_str(x.decode()) if x else "" for x in raws], add_special_tokens=False)
            return np.fromiter((k for e in each for k in e.ids), "<u4"), np.array([len(e.ids) for e in each], np.int64)
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for keys, n, texts in self.batches(raws):
            flat, size = self.known.gather(self.places(keys, texts))
            ids.append(flat)
            sizes.append(C.summed_by(size, n))
        return np.concatenate(ids), np.concatenate(sizes)

    def ids_of(self, new: list[str]) -> list[list[int]]:
        """Encode distinct segments, many to a text where line ends part them: a line end is a byte of its own, which
        merges with nothing, so what lies between two of them are a segment's ids."""
        out: list = [None] * len(new)
        bpe = self.model.kind == BPE
        joined = bpe and self.model.byte_fallback and self.line_end is not None
        plain = [k for k, s in enumerate(new) if joined and s != "\n" and not s.startswith("  ")]
        groups = [plain[k : k + 64] for k in range(0, len(plain), 64)]
        for part, e in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(new[k] for k in g) for g in groups], add_special_tokens=False)):
            ids, at = e.ids, 0
            if ids.count(self.line_end) == len(part) - 1:
                for k in part:
                    end = ids.index(self.line_end, at) if k != part[-1] else len(ids)
                    out[k] = ids[at:end]
                    at = end + 1
        rest = []
        for k, s in enumerate(new):
            if out[k] is None and bpe and s.startswith("  "):
                out[k] = self.merge(s.replace(" ", MARK))
            elif out[k] is None:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@functools.lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """The worker process's codec: what it has learnt serves all its tasks."""
    return Codec(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", verify: bool = True, keep_ids: bool = False) -> DataFrame:
    """For every row: doc_id, n_tokens, ids_crc32 (of the ids as little-endian uint32), decoded_sha256, round_trip (the
    decoded ids are the text), parity (the sentencepiece library gives the same ids; null unless ``verify``), and ids
    (array<int>) if ``keep_ids``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, other = codec_of(path), None
        if verify:
            import sentencepiece

            other = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in (y for x in it for y in C.batches([x], 1 << 20)):
            raws = C.utf8(b.column(1))
            texts = [x.decode() for x in raws]
            flat, sizes = codec.encode(raws)
            ids = np.split(flat, np.cumsum(sizes)[:-1])
            lists = [x.tolist() for x in ids]
            back = codec.decode(lists)
            same = [x == y for x, y in zip(lists, other.encode(texts, num_threads=1))] if other else [None] * len(texts)
            columns = [
                b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()), pa.array([x == y for x, y in zip(back, texts)], pa.bool_()), pa.array(same, pa.bool_()),
            ]
            names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity"]
            if keep_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(C.tidied(run), f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean" + ", ids array<int>" * keep_ids)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_decode(C.table(spark, sf_dir, "documents"), model_path())
