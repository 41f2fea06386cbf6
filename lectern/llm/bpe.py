"""Encoding with a public byte-level BPE vocabulary.

Two tiers.  A text is cut into pre-tokens by vectorised tests over its code points.
Tier one packs each pre-token into three machine words and asks a minimal perfect hash
(built level by level over the vocabulary) for the one entry it could be; comparing the
packed words makes the answer exact.  Tier two takes the pre-tokens that are no entry:
their bytes form a linked list, and a heap of adjacent pairs ordered by rank merges
them.  The vocabulary is a file of a public tokenizer, named by the caller; it is read on
the driver and broadcast, its size being fixed by the vocabulary and not by the data.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lectern.functions.arrowtext import code_points, list_array, text_chunks

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that form a pre-token with the apostrophe before them.
SHORT_ENDINGS, LONG_ENDINGS = "sdmt", ("ll", "ve", "re")
#: Longest entry, in bytes, that the first tier holds.
PACKED = 24
#: Merged pre-tokens a worker remembers before it starts afresh (memory, not results).
REMEMBERED = 1 << 18
#: A longer text is encoded in parts that end where a pre-token must end.
PART_CHARS = 1 << 20


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_ranks(path: str) -> dict[bytes, int]:
    """The entries of a ``.tiktoken`` file (base64 bytes, rank) by their bytes."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def character_classes() -> np.ndarray:
    """Class (letter, number, white space, other) of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def _mix(words: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of packed pre-tokens (n x 3 words and their lengths)."""
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    for k in range(words.shape[1]):
        h ^= words[:, k]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash: at each level keys alone in their cell get the cell, the
    others go on to the next level; a key's number is the rank of its cell."""

    def __init__(self, words: np.ndarray, size: np.ndarray, gamma: float = 2.0) -> None:
        self.cells: list[np.ndarray] = []
        left, taken = np.arange(len(size)), 0
        while len(left):
            n = max(64, int(gamma * len(left)))
            cell = (_mix(words[left], size[left], len(self.cells)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(cell, minlength=n) == 1
            number = np.where(alone, np.cumsum(alone) - 1 + taken, -1).astype(np.int32)
            self.cells.append(number)
            taken += int(alone.sum())
            left = left[~alone[cell]]

    def lookup(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number each key would have; -1 where it reaches no cell."""
        out = np.full(len(size), -1, np.int32)
        left = np.arange(len(size))
        for level, number in enumerate(self.cells):
            if not len(left):
                break
            at = number[(_mix(words[left], size[left], level) % np.uint64(len(number))).astype(np.int64)]
            out[left] = at
            left = left[at < 0]
        return out


def _pack(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 24 bytes of each slice as three little-endian words, zero padded."""
    padded = data + bytes(PACKED + 8)
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    words = np.empty((len(start), PACKED // 8), np.uint64)
    for k in range(PACKED // 8):
        n = np.clip(size - 8 * k, 0, 8)
        keep = np.where(n == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(n, 7)).astype(np.uint64)) - np.uint64(1))
        words[:, k] = view[np.minimum(start + 8 * k, len(view) - 1)] & keep
    return words


class ByteBPE:
    """Encoder of one vocabulary; pickled once per broadcast."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.classes = character_classes()
        entries = [x for x in self.ranks if len(x) <= PACKED]
        size = np.array([len(x) for x in entries], np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        words = _pack(b"".join(entries), start, size)
        self.hash = PerfectHash(words, size)
        number = self.hash.lookup(words, size)
        self.entry_words = np.zeros_like(words)
        self.entry_size = np.zeros(len(size), np.int64)
        self.entry_id = np.zeros(len(size), np.int32)
        self.entry_words[number], self.entry_size[number] = words, size
        self.entry_id[number] = [self.ranks[x] for x in entries]
        self.id_bytes = np.zeros(max(self.ranks.values(), default=0) + 1, np.int32)
        for x, k in self.ranks.items():
            self.id_bytes[k] = len(x)
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    # -- cutting into pre-tokens ---------------------------------------------------

    def starts(self, points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """Mask over code points: where a pre-token starts.  ``text_start``: positions
        at which a text starts; nothing joins across them."""
        n = len(points)
        kind = self.classes[points]
        first = np.zeros(n + 1, bool)
        first[text_start] = True
        first[n] = True
        space = kind == SPACE
        before = np.empty(n, np.uint8)
        before[:1], before[1:] = 255, kind[:-1]
        before[first[:-1]] = 255
        out = kind != before
        # the last space of a run before something else starts a pre-token ...
        ends = space.copy()
        ends[:-1] &= ~space[1:]
        ends &= ~first[1:]
        out |= ends
        # ... and takes what follows along, if it is a plain space
        joined = np.zeros(n, bool)
        joined[1:] = ends[:-1] & (points[:-1] == 32)
        out &= ~joined
        quotes = np.flatnonzero((points == 39) & out)
        if len(quotes):
            following = np.full((2, len(quotes)), -1, np.int64)
            for k in (0, 1):
                at = quotes + 1 + k
                ok = (at < n) & ~first[np.minimum(quotes + 1, n)]
                if k:
                    ok &= ~first[np.minimum(at, n)]
                following[k][ok] = points[at[ok]]
            short = np.isin(following[0], [ord(c) for c in SHORT_ENDINGS])
            pair = np.zeros(len(quotes), bool)
            for a, b in LONG_ENDINGS:
                pair |= (following[0] == ord(a)) & (following[1] == ord(b))
            for chosen, size in ((short, 2), (pair & ~short, 3)):
                at = quotes[chosen]
                out[at + 1] = False
                after = at + size
                out[after[after < n]] = True
        return out

    # -- second tier ---------------------------------------------------------------

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: lowest-ranked adjacent pair first, leftmost first
        among equals, until no pair is an entry."""
        ranks, n = self.ranks, len(word)
        whole = ranks.get(word)
        if whole is not None:
            return (whole,)
        nxt = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that starts here; 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (r := ranks.get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = prev[i]
            if h >= 0 and (r := ranks.get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = nxt[i]
        return tuple(out)

    # -- whole columns -------------------------------------------------------------

    def _encode_bytes(self, data: bytes, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of joined texts, the number of ids before each text (and in all), and a
        mask of the ids that start a pre-token."""
        points, at = code_points(data)
        edges = text_at if at is None else np.searchsorted(at, text_at)
        start = np.flatnonzero(self.starts(points, np.unique(edges[:-1][edges[:-1] < len(points)])))
        if at is not None:
            start = at[start]
        size = np.diff(np.append(start, len(data)))
        words = _pack(data, start, size)
        number = self.hash.lookup(words, size)
        known = number >= 0
        known &= size == self.entry_size[number]
        for k in range(words.shape[1]):
            known &= words[:, k] == self.entry_words[number, k]
        counts = np.ones(len(start), np.int64)
        missed = np.flatnonzero(~known)
        memo, merged = self.memo, []
        for s, e in zip(start[missed].tolist(), (start + size)[missed].tolist()):
            word = data[s:e]
            ids = memo.get(word)
            if ids is None:
                if len(memo) >= REMEMBERED:
                    memo.clear()
                ids = memo[word] = self.merge(word)
            merged.append(ids)
        lengths = np.fromiter(map(len, merged), np.int64, len(merged))
        counts[missed] = lengths
        before = np.zeros(len(start) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        ids = np.empty(before[-1], np.int32)
        ids[before[:-1][known]] = self.entry_id[number[known]]
        if len(missed):
            flat = np.fromiter(chain.from_iterable(merged), np.int32, int(lengths.sum()))
            shift = before[missed] - np.concatenate([[0], np.cumsum(lengths)[:-1]])
            ids[np.repeat(shift, lengths) + np.arange(len(flat))] = flat
        opens = np.zeros(len(ids), bool)
        opens[before[:-1]] = True
        return ids, before[np.searchsorted(start, text_at)], opens

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For consecutive rows lo:hi: lo, hi, ids, offsets of the rows in ids, opens."""
        for chunk in text_chunks(column):
            if chunk.hi - chunk.lo > 1 or len(chunk.data) <= 2 * PART_CHARS:
                yield chunk.lo, chunk.hi, *self._encode_bytes(chunk.data, chunk.offsets)
                continue
            parts = [self._encode_bytes(x, np.array([0, len(x)])) for x in self.parts(chunk.data)]
            ids = np.concatenate([p[0] for p in parts])
            yield chunk.lo, chunk.hi, ids, np.array([0, len(ids)]), np.concatenate([p[2] for p in parts])

    def parts(self, data: bytes) -> Iterator[bytes]:
        """A long text in parts: a plain space between two ASCII letters or digits
        always starts a pre-token, so a cut there changes nothing."""
        import re

        cut, at = re.compile(rb"[A-Za-z0-9](?= [A-Za-z0-9])"), 0
        while at < len(data):
            found = cut.search(data, at + PART_CHARS)
            end = found.end() if found else len(data)
            yield data[at:end]
            at = end

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        column = pa.array([text], pa.string())
        return [int(i) for _, _, ids, _, _ in self.encode_column(column) for i in ids]


_LOADED: dict[str, ByteBPE] = {}


def load_bpe(path: str | None = None) -> ByteBPE:
    """The encoder of a vocabulary file, built once per process."""
    path = path or default_vocabulary()
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def broadcast_bpe(spark: SparkSession, path: str | None = None):
    """The encoder as a broadcast variable: a few MB, fixed by the vocabulary."""
    return spark.sparkContext.broadcast(load_bpe(path))


def encode_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_column, ids array<int>): the token ids of every text, no special tokens.

    One narrow pass over the two columns named, without a shuffle.  Null and empty
    texts give an empty list; rows are kept as they come, repeated ones too; the names
    of special tokens are ordinary text; other columns of the table are not read, so
    their names cannot clash.  An empty table gives no rows.
    """
    source = documents.select(id_column, text_column)
    kind = source.schema[id_column].dataType
    bpe = broadcast_bpe(documents.sparkSession, vocabulary)
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.value
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo, hi, ids, offsets, _ in encoder.encode_column(texts):
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), list_array(offsets, pa.array(ids, pa.int32()))], [id_column, "ids"])

    return source.mapInArrow(run, schema)
