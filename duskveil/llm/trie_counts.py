"""Token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are the segments of its normalised form (sentencepiece_backend): a run of markers with what follows
it, and line ends. Distinct pre-tokens are inserted in a trie, many at a time: sorted, those with a common prefix stand side by side,
and the nodes of one depth are the distinct prefixes of that length. A node's best unigram score, and the
number of tokens on its best path, are computed from its ancestors, once for all pre-tokens that share the prefix, and for all nodes of a
depth together. The node where a pre-token ends (its terminal) holds its count. A path's score is the sum of its
pieces' scores; of equal paths, the one whose last piece starts first wins. A character that is no piece scores the
lowest piece's score less 10, and counts as its UTF-8 bytes under byte fallback, else as one token.

Scores are log probabilities. A Unigram model brings its own. A BPE model, as the given one is, has only ranks of merges, which say nothing of
sums; its pieces' probabilities are then taken from the corpus: how often the model's own merges make each piece, over all documents, with 0.5
added (``piece_scores``). So ``n_tokens`` and ``score`` are those of a unigram tokenizer of the model's pieces, and ``n_model_tokens`` is
the count of the model itself, by its merges (or by its lattice, for a Unigram model), as in op9.

A worker remembers terminals by 64-bit hashes, at most about ``TERMINALS`` of them, and then starts anew, which changes no count. What is
shuffled and broadcast has a row for each piece of the vocabulary.

Defined results: a null or empty text has no tokens and a score of 0; very long texts and pre-tokens are counted whole; repeated rows are
counted each on their own; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .sentencepiece_backend import MARK, NORMAL, UNIGRAM, USER_DEFINED, ModelFile, codec_of, model_path

TERMINALS = 400_000
#: Pre-tokens of more characters take a path of their own, without shared prefixes.
WIDTH = 40
ROWS = 10_000  # pre-tokens inserted together


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


class Trie:
    """Token counts and scores of pre-tokens. ``scores``: of pieces, where they are not the model's own."""

    def __init__(self, model: ModelFile, scores: dict[str, float] | None = None):
        self.scores = scores if scores is not None else {p: float(s) for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED) and p}
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.bytes = model.byte_fallback
        self.base = np.uint64(C.GOLDEN)
        self.powers = np.array([pow(C.GOLDEN, k, 1 << 64) for k in range(WIDTH + 1)], np.uint64)
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: ascending hashes, scores
        by: dict[int, list] = {}
        for p, s in self.scores.items():
            if len(p) <= WIDTH:
                by.setdefault(len(p), []).append((p, s))
        for n, own in by.items():
            h = self._hashes(np.stack([_codes(p) for p, _ in own]))[:, n]
            order = np.argsort(h)
            self.pieces[n] = h[order], np.array([s for _, s in own])[order]
        self.terminals = C.Known(count=np.int64, best=np.float64, model=np.int64)

    def _hashes(self, chars: np.ndarray) -> np.ndarray:
        """Of each row, the hash of each prefix."""
        out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
        for d in range(chars.shape[1]):
            out[:, d + 1] = out[:, d] * self.base + (chars[:, d] + np.uint64(1)) * np.uint64(C.MIX1)
        return out

    def measure(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, scores) of distinct pre-tokens."""
        count, best = np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
        short = sorted((k for k, t in enumerate(tokens) if 0 < len(t) <= WIDTH), key=tokens.__getitem__)
        for part in (short[k : k + ROWS] for k in range(0, len(short), ROWS)):
            count[part], best[part] = self._levels([tokens[k] for k in part])
        for k, t in enumerate(tokens):
            if len(t) > WIDTH:
                count[k], best[k] = self._alone(t)
        return count, best

    def _levels(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token counts, scores) of sorted pre-tokens: the trie's nodes depth by depth."""
        size = np.array([len(t) for t in tokens])
        width, n = int(size.max()), len(tokens)
        chars = np.zeros((n, width), np.uint64)
        chars[np.arange(width) < size[:, None]] = _codes("".join(tokens))
        differ = np.concatenate([chars[1:] != chars[:-1], np.ones((n - 1, 1), bool)], axis=1)
        shared = np.concatenate([[0], np.minimum(differ.argmax(1), np.minimum(size[1:], size[:-1]))])
        h = self._hashes(chars)
        best, count = np.zeros((n, width + 1)), np.zeros((n, width + 1), np.int64)
        for d in range(1, width + 1):
            rows = np.flatnonzero(size >= d)
            new = shared[rows] < d  # the first row of each node
            node = rows[new]
            top, k = np.full(len(node), -np.inf), np.zeros(len(node), np.int64)
            single = np.zeros(len(node), bool)
            for w in range(min(self.longest, d), 0, -1):  # the longest last piece first: it starts first
                if w not in self.pieces:
                    continue
                keys, scores = self.pieces[w]
                want = h[node, d] - h[node, d - w] * self.powers[w]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == want)
                score = best[node[hit], d - w] + scores[at[hit]]
                more = score > top[hit]
                hit, score = hit[more], score[more]
                top[hit], k[hit] = score, count[node[hit], d - w] + 1
                if w == 1:
                    single[np.flatnonzero(keys[at] == want)] = True
            score = best[node, d - 1] + self.unknown
            odd = np.flatnonzero(~single & (score > top))
            if len(odd):
                c = chars[node[odd], d - 1]
                length = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF) if self.bytes else np.ones(len(odd), np.int64)
                top[odd], k[odd] = score[odd], count[node[odd], d - 1] + length
            of = np.cumsum(new) - 1
            best[rows, d], count[rows, d] = top[of], k[of]
        every = np.arange(n)
        return count[every, size], best[every, size]

    def _alone(self, token: str) -> tuple[int, float]:
        best, count = [0.0], [0]
        for d in range(1, len(token) + 1):
            top, n = None, 0
            for k in range(max(0, d - self.longest), d):
                s = self.scores.get(token[k:d])
                if s is not None and (top is None or best[k] + s > top):
                    top, n = best[k] + s, count[k] + 1
            ch = token[d - 1]
            if ch not in self.scores and (top is None or best[-1] + self.unknown > top):
                top, n = best[-1] + self.unknown, count[-1] + (len(ch.encode()) if self.bytes else 1)
            best.append(top)
            count.append(n)
        return count[-1], best[-1]


def _probabilities(pieces: list[str], counts: np.ndarray) -> dict[str, float]:
    """Log probabilities of pieces that occur so often, with 0.5 added to each count."""
    total = math.log(counts.sum() + 0.5 * len(pieces)) if pieces else 0.0
    return dict(zip(pieces, (np.log(counts + 0.5) - total).tolist()))


def piece_scores(docs: DataFrame, path: str, text: str = "text") -> dict[str, float] | None:
    """The log probabilities of a BPE model's pieces: how often its merges make each of them in ``docs``. None for a Unigram model."""
    model = ModelFile.load(path)
    if model.kind == UNIGRAM:
        return None
    size = len(model.pieces)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, total = codec_of(path), np.zeros(size, np.int64)
        for b in it:
            total += np.bincount(codec.encode(C.utf8(b.column(0)))[0], minlength=size)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["id", "n"])

    n = np.zeros(size, np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(C.tidied(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # as long as the vocabulary
        n[r["id"]] = r["n"]
    own = [k for k, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED) and p]
    return _probabilities([model.pieces[k][0] for k in own], n[own])


@functools.lru_cache(maxsize=1)
def _trie(path: str, names: tuple[str, ...] | None, scores: tuple[float, ...] | None) -> Trie:
    """The worker process's trie: its terminals serve all its tasks."""
    return Trie(codec_of(path).model, None if names is None else dict(zip(names, scores)))


def token_counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_pretokens long, n_tokens long, score double, n_model_tokens long) for every row."""
    found = piece_scores(docs, path, text)
    shared = docs.sparkSession.sparkContext.broadcast((None, None) if found is None else (tuple(found), tuple(found.values())))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, trie = codec_of(path), _trie(path, *shared.value)
        held = trie.terminals

        def values(new: list[str]) -> dict[str, np.ndarray]:
            count, best = trie.measure([s.replace(" ", MARK) for s in new])
            return {"count": count, "best": best, "model": np.array([len(x) for x in codec.ids_of(new)])}

        def whole(raw: bytes) -> tuple:
            t = codec.steps.normalize_str(raw.decode()) if raw else ""
            count, best = trie.measure([t])
            return int(bool(t)), count[0], best[0], int(codec.encode([raw])[1][0])

        for b in (y for x in it for y in C.batches([x], 2 << 20)):
            raws = C.utf8(b.column(1))
            if codec.by_segment:
                parts = []
                for keys, n, texts in codec.batches(raws):
                    if held.n > TERMINALS:
                        held.clear()
                    at = held.learn(keys, lambda new, texts=texts: values(texts(new)))
                    parts.append([n, *(C.summed_by(held.beside[k][at], n) for k in ("count", "best", "model"))])
                out = [np.concatenate(x) for x in zip(*parts)]
            else:
                out = [np.array(x) for x in zip(*map(whole, raws))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(t)) for x, t in zip(out, ("i8", "i8", "f8", "i8")))], ["doc_id", "n_pretokens", "n_tokens", "score", "n_model_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(C.tidied(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long, score double, n_model_tokens long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(C.table(spark, sf_dir, "documents"), model_path())
