"""Evaluation texts inside training texts, found with spaced seeds.

Both sides are reduced to their letters and digits (one case, look-alikes unified,
accents kept), so spaces, line ends, hyphens and invisible characters cannot hide a
passage: these symbols are the tokens.  A spaced seed is a fixed mask over consecutive
symbols that ignores some of them: equal hashes under a mask mean equal symbols at the
positions that count, whatever stands at the others.

Every position of every item is a seed under each mask; the seeds are a table.  One scan of
the documents hashes every position under the same masks, tests the hashes against a bitmap
of the seeds' hashes, whose size is bounded, and writes what passes: the hashes, and the
stretch of text around them.  Those hashes are joined with the seeds.  Hits on one diagonal
are one: the item is laid over the stretch there and compared symbol by symbol, many
diagonals at once: the longest run of equal words and the best share of equal symbols over
a window follow, substitutions tolerated.  Where a word was replaced by a longer or shorter
one, what follows it lies on a diagonal nearby; the share counts both sides of one such
break.

A window that occurs in a document in full brings its seeds along, so no exact overlap is
lost.  Windows with fewer symbols than a mask have a seed of their own length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrowtext import code_points, list_array, string_buffers, text_chunks
from lectern.llm.characters import skeleton_table
from lectern.session import discard, spread, written

WORDS = 8
#: Positions that count (1) and that are ignored (0).
MASKS = ("1110110010110111", "110100110111010111")
#: Least share of equal symbols over a window of words for an overlap to be reported.
LEAST_SHARE = 0.8
#: Most symbols by which a word in another's place may be longer or shorter.
MAX_BREAK = 16
#: The bitmap has about so many bits for each seed, but no fewer and no more than 2 to these powers (8 MB).
SEED_BITS = 1024
BITMAP_BITS = (16, 26)
#: Symbols of items that are compared at once.
CELLS = 1 << 20
#: Parts of the hits of one hash.
SALTS = 8


class Skeleton:
    """Texts as arrays of the symbols that count."""

    def __init__(self) -> None:
        self.table = skeleton_table()

    def of_bytes(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of joined texts and the number of symbols before each."""
        if data.isascii():
            points, edges = np.frombuffer(data, np.uint8), offsets
        else:
            texts, edges = [], np.zeros(len(offsets), np.int64)
            for k in range(len(offsets) - 1):
                x = data[offsets[k] : offsets[k + 1]]
                text = x.decode("utf-8", "replace")
                texts.append(text if x.isascii() else unicodedata.normalize("NFKD", text))
                edges[k + 1] = edges[k] + len(texts[-1])
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.table[points]
        kept = symbols != 0
        before = np.zeros(len(points) + 1, np.int64)
        np.cumsum(kept, out=before[1:])
        return symbols[kept], before[edges]

    def of(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass")
        return self.of_bytes(data, np.array([0, len(data)]))[0]


def _text(symbols: np.ndarray) -> str:
    return symbols.astype("<u4").tobytes().decode("utf-32-le", "replace")


def seed_hashes(symbols: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask laid at each position (none where it would stick out)."""
    n = len(symbols) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = symbols.astype(np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out *= np.uint64(0x100000001B3)
            out += wide[k : k + n]
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(31))


_SEED = T.StructType([T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType())])
_ARROW_SEED = pa.struct([("hash", pa.int64()), ("at", pa.int32())])


def _seed_lists(hashes: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return list_array(offsets, pa.StructArray.from_arrays([pa.array(hashes.view(np.int64), pa.int64()), pa.array(at, pa.int32())], names=["hash", "at"]))


def item_seeds(items: DataFrame, words: int = WORDS, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(item_id, symbols, word_at, seeds, reach, masks): the items of at least ``words``
    words with the number of symbols before each word, their seeds, the symbols of their
    longest window, and the masks used."""
    skeleton, least = items.sparkSession.sparkContext.broadcast(Skeleton()), len(masks[0])
    source = items.select("item_id", "text").dropna(subset=["text"]).distinct()
    schema = T.StructType([source.schema["item_id"], T.StructField("symbols", T.StringType()), T.StructField("word_at", T.ArrayType(T.IntegerType())), T.StructField("seeds", T.ArrayType(_SEED)), T.StructField("reach", T.IntegerType()), T.StructField("masks", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                parts = [skeleton.value.of(w) for w in text.split(" ") if w]
                if len(parts) < words:
                    continue
                symbols, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                sizes = at[words:] - at[:-words]
                used = [*masks, *("1" * int(n) for n in np.unique(sizes[(sizes > 0) & (sizes < least)]))]
                hashes = [seed_hashes(symbols, m) for m in used]
                places = np.concatenate([np.arange(len(h)) for h in hashes])
                rows.append(row)
                out.append((_text(symbols), at.tolist(), _seed_lists(np.concatenate(hashes), places, np.array([0, len(places)])), int(sizes.max()), used))
            if rows:
                symbols, at, seeds, reach, used = zip(*out)
                columns = [batch.column(0).take(pa.array(rows)), pa.array(symbols, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.concat_arrays(list(seeds)), pa.array(reach, pa.int32()), pa.array(used, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """Which of 2 to the power of ``bits`` classes have a seed's hash, eight in a byte:
    at most one row for 64 classes comes to the driver."""
    word = F.shiftrightunsigned("hash", 64 - bits + 6)
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - bits}) & 63 AS INT))")
    rows = seeds.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("set")).toPandas()
    out = np.zeros(1 << bits - 6, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64)
    return out.view(np.uint8)


class Scan:
    """Hashes of documents that may be a seed's, and the text around them."""

    def __init__(self, bits: int, packed: np.ndarray, masks: list[str], reach: int) -> None:
        self.bits, self.packed, self.masks, self.reach, self.skeleton = bits, packed, masks, reach, Skeleton()

    def spots(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, list[str], pa.ListArray] | None:
        """Row, stretch of symbols and hits in it, for the stretches of a chunk.  Hits
        further apart than two windows have stretches of their own."""
        symbols, edges = self.skeleton.of_bytes(data, offsets)
        found = []
        for mask in self.masks:
            hashes = seed_hashes(symbols, mask)
            known = self.packed[(hashes >> np.uint64(64 - self.bits + 3)).astype(np.int64)] >> ((hashes >> np.uint64(64 - self.bits)) & np.uint64(7)).astype(np.uint8)
            at = np.flatnonzero(known & 1)
            row = np.searchsorted(edges, at, "right") - 1
            inside = at + len(mask) <= edges[row + 1]
            found.append((at[inside], row[inside], hashes[at[inside]]))
        at, row, hashes = (np.concatenate(x) for x in zip(*found))
        if not len(at):
            return None
        order = np.argsort(at, kind="stable")
        at, row, hashes = at[order], row[order], hashes[order]
        opens = np.ones(len(at), bool)
        opens[1:] = (row[1:] != row[:-1]) | (np.diff(at) > 2 * self.reach)
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(at)) - 1
        a = np.maximum(at[first] - self.reach, edges[row[first]])
        b = np.minimum(at[last] + 2 * self.reach, edges[row[first] + 1])
        texts = [_text(symbols[x:y]) for x, y in zip(a.tolist(), b.tolist())]
        return row[first], texts, _seed_lists(hashes, at - np.repeat(a, last - first + 1), np.append(first, len(at)))


def _overlaps(symbols: np.ndarray, at: np.ndarray, count: np.ndarray, laid: np.ndarray, words: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """With items laid over stretches, one of each in a row (``laid`` has MAX_BREAK symbols
    more on either side; ``at`` says before which symbol each of ``count`` words starts,
    and repeats the last position beyond): the longest run of words that are equal in full,
    and the best share of equal symbols over a window.  A share below ``least``, but no
    less than half of it, is looked at again with the words before or after some word
    laid up to MAX_BREAK symbols aside."""
    n = symbols.shape[1]

    def equal(rows: np.ndarray, shift: int) -> np.ndarray:
        total = np.zeros((len(rows), n + 1), np.int32)
        np.cumsum(laid[rows, MAX_BREAK + shift : MAX_BREAK + shift + n] == symbols[rows], axis=1, out=total[:, 1:])
        return np.take_along_axis(total, at[rows], axis=1)

    every = np.arange(len(laid))
    total = equal(every, 0)
    same = (np.diff(total, axis=1) == np.diff(at, axis=1)) & (np.arange(at.shape[1] - 1) < count[:, None])
    run, best = np.zeros(len(laid), np.int32), np.zeros(len(laid), np.int32)
    for k in range(same.shape[1]):
        run = (run + 1) * same[:, k]
        np.maximum(best, run, out=best)
    length = np.maximum(at[:, words:] - at[:, :-words], 1).astype(np.float64)
    length[np.arange(length.shape[1]) > count[:, None] - words] = np.inf  # no window
    share = ((total[:, words:] - total[:, :-words]) / length).max(axis=1)
    # of two sides that reach the share together, one has half of it
    near = np.flatnonzero((share >= least / 2) & (share < least))
    if len(near):
        here = total[near]
        for shift in (k for k in range(-MAX_BREAK, MAX_BREAK + 1) if k):
            aside = equal(near, shift)
            for left, right in ((here, aside), (aside, here)):
                gain = np.lib.stride_tricks.sliding_window_view(left - right, words + 1, axis=1).max(axis=2)
                share[near] = np.maximum(share[near], ((right[:, words:] - left[:, :-words] + gain) / length[near]).max(axis=1))
    return best, share


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a string column, and where each row's start."""
    data, offsets = string_buffers(column)
    points, at = code_points(bytes(data[offsets[0] : offsets[-1]]))
    return points, offsets - offsets[0] if at is None else np.searchsorted(at, offsets - offsets[0])


def _padded(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, lead: np.ndarray, width: int) -> np.ndarray:
    """Rows of joined values as a matrix: each from ``lead`` on, 0 around it."""
    place = offsets[rows, None] + np.arange(width) - lead[:, None]
    there = (place >= offsets[rows, None]) & (place < offsets[rows + 1, None])
    return np.where(there, values[np.where(there, place, 0)], 0) if len(values) else np.zeros(place.shape, np.uint32)


def find_leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, least_share: float = LEAST_SHARE, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """One row per item and document whose texts overlap.

    Columns: ``item_id``, ``doc_id``, ``equal_words`` (longest run of item words that
    the document holds, letters and digits only) and ``share`` (best share of equal
    symbols over ``words`` consecutive item words).  A pair is reported if
    ``equal_words`` reaches ``words`` or ``share`` reaches ``least_share``.  None with
    ``words`` equal words is missed; an overlap with substitutions is missed if they leave
    no position where a mask fits (how often: README), and a window of fewer symbols than
    a mask is found only where it is equal.

    Nothing of the documents or items goes to the driver but the bitmap of the seeds, at
    most 8 MB; items beyond the number it is made for let more positions pass, which the
    join then drops.  Null and empty texts, and items of fewer than ``words`` words,
    overlap with nothing.  Repeated documents each get their rows, those with one id
    together; an item row repeated in full counts once.  Other columns are not read.
    """
    spark = documents.sparkSession
    source = documents.select("doc_id", "text")
    known = written(item_seeds(items, words, masks).withColumn("item", F.monotonically_increasing_id()), "items")
    schema = T.StructType([known.schema["item_id"], source.schema["doc_id"], T.StructField("equal_words", T.IntegerType()), T.StructField("share", T.DoubleType())])
    figures = known.agg(F.sum(F.size("seeds")).alias("seeds"), F.max("reach").alias("reach")).first()
    if not figures["seeds"]:
        return spark.createDataFrame([], schema)
    used = sorted({*masks, *(r[0] for r in known.select(F.explode("masks")).distinct().collect())})  # masks, and lengths below theirs
    bits = min(max(int(SEED_BITS * figures["seeds"]).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    seeds = known.select("item", F.explode("seeds").alias("s")).select("item", "s.hash", F.col("s.at").alias("item_at"))
    shared = spark.sparkContext.broadcast(Scan(bits, bitmap(seeds, bits), used, int(figures["reach"]) + MAX_BREAK))

    spot_schema = T.StructType([source.schema["doc_id"], T.StructField("stretch", T.StringType()), T.StructField("hits", T.ArrayType(_SEED))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                found = shared.value.spots(chunk.data, chunk.offsets)
                if found:
                    rows, stretches, hits = found
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(chunk.lo + rows)), pa.array(stretches, pa.string()), hits], names=spot_schema.names)

    spots = written(source.mapInArrow(scan, spot_schema).withColumn("spot", F.monotonically_increasing_id()), "spots")
    hits = spots.select("spot", F.explode("hits").alias("h")).select("spot", "h.hash", F.col("h.at").alias("spot_at"), F.pmod("spot", F.lit(SALTS)).alias("salt"))
    salted = seeds.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    diagonals = hits.join(salted, ["hash", "salt"]).select("spot", "item", (F.col("spot_at") - F.col("item_at")).alias("shift")).distinct()
    # the part of the stretch that the item covers, MAX_BREAK symbols more on either side
    size = known.select("item", F.length("symbols").alias("size"))
    start = F.col("shift") - MAX_BREAK
    cut = F.substring("stretch", F.greatest(start, F.lit(0)) + 1, F.col("size") + 2 * MAX_BREAK + F.least(start, F.lit(0)))
    laid = diagonals.join(size, "item").join(spots.select("spot", "doc_id", "stretch"), "spot").select("item", "doc_id", F.greatest(-start, F.lit(0)).alias("lead"), cut.alias("cut"))
    pairs = spread(laid.join(known.select("item", "item_id", "symbols", "word_at"), "item")).sortWithinPartitions(F.length("symbols"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023,E731
            cuts, (symbols, symbol_edges) = _points(get("cut")), _points(get("symbols"))
            at, at_edges = get("word_at").flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(get("word_at").value_lengths().to_numpy(zero_copy_only=False)))
            lead = get("lead").to_numpy(zero_copy_only=False).astype(np.int64)
            best, share = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            sizes = np.diff(symbol_edges)
            a = 0
            while a < batch.num_rows:  # rows are in order of their items' length
                b = a + max(1, int((np.arange(1, batch.num_rows - a + 1) * np.maximum.accumulate(sizes[a:]) <= CELLS).sum()))
                rows = np.arange(a, b)
                n, none = int(sizes[a:b].max()), np.zeros(b - a, np.int64)
                count = np.diff(at_edges)[a:b] - 1
                place = np.minimum(at_edges[rows, None] + np.arange(int(count.max()) + 1), at_edges[rows + 1, None] - 1)
                best[a:b], share[a:b] = _overlaps(_padded(symbols, symbol_edges, rows, none, n), at[place].astype(np.int64), count, _padded(*cuts, rows, lead[a:b], n + 2 * MAX_BREAK), words, least_share)
                a = b
            good = np.flatnonzero((best >= words) | (share >= least_share))
            if len(good):
                take = pa.array(good)
                yield pa.RecordBatch.from_arrays([get("item_id").take(take), get("doc_id").take(take), pa.array(best[good], pa.int32()), pa.array(share[good], pa.float64())], names=schema.names)

    found = written(pairs.mapInArrow(verify, schema), "leaks")
    discard(spots, known)
    return found.groupBy("item_id", "doc_id").agg(F.max("equal_words").alias("equal_words"), F.max("share").alias("share"))
