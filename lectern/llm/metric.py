"""Exact radius joins of strings in a metric space.

Strings are compared by the Damerau-Levenshtein distance (insertions, deletions,
substitutions and swaps of neighbours, any of them next to each other), a true metric.  A
bounded set of pivots divides the space: every string has its home in the cell of its
nearest pivot, and is a guest of every other cell that could hold a partner.  By the
triangle inequality a string x can have a partner within r at home in the cell of pivot p
only if d(x, p) is at most r more than the largest distance of the cell's residents from
p, and at most 2r more than x's distance from its own pivot.

A cell with more strings than a bound is divided again, by the same inequality: partners'
distances from the pivot differ by at most r, so residents at one distance meet members
within r of it; what is still too large is cut into blocks of residents and of members,
every block of the one meeting every block of the other.  So no task holds more than a
stated number of strings, however they cluster, and no pair is lost.  Inside a block
lengths and letters that r edits cannot change rule out most pairs; the distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import discard, spread, written

#: The most pivots.  Their number grows with the square root of the strings.
MAX_PIVOTS = 512
#: Residents, and members, of one block about at most.
BLOCK = 4096
PAIRS = 1 << 14
#: Cells of a matrix of residents and members tested at once.
MATRIX = 1 << 22


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of code points, and their lengths."""
    length = np.array([len(w) for w in words], np.int32)
    out = np.zeros((len(words), max(1, int(length.max(initial=0)))), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return out, length


def letters(words: list[str]) -> np.ndarray:
    """64 bits of each string: which characters occur, and which occur twice.  Inserting or
    removing a character changes one bit at most, replacing one two, a swap none."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        bits = twice = 0
        for c in w:
            bit = 1 << (ord(c) & 31)
            twice |= bits & bit
            bits |= bit
        out[i] = bits | twice << 32
    return out


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Damerau-Levenshtein distance of row i of ``a`` and row i of ``b``, all rows at once;
    ``a`` may be one row for all."""
    n = len(lb)
    if not n:
        return np.zeros(0, np.int32)
    one = len(a) == 1
    wa, wb = int(la.max()), int(lb.max())
    step = max(1, PAIRS * 400 // ((wa + 2) * (wb + 2)))
    if n > step:
        part = lambda x, i: x if one else x[i : i + step]
        return np.concatenate([distances(part(a, i), part(la, i), b[i : i + step], lb[i : i + step]) for i in range(0, n, step)])
    kind = np.uint8 if wa + wb < 120 else np.int32
    far = kind(wa + wb + 1)
    d = np.full((wa + 2, wb + 2, n), far, kind)  # with a border beyond the empty prefixes
    d[1:, 1] = np.arange(wa + 1, dtype=kind)[:, None]
    d[1, 1:] = np.arange(wb + 1, dtype=kind)[:, None]
    tb = np.ascontiguousarray(b[:, :wb].T)
    last = np.zeros((wb, n), np.int16)  # the last place before in a of the character of b
    rows = np.arange(n)
    for i in range(1, wa + 1):
        same = tb == (a[0, i - 1] if one else a[:n, i - 1])
        match = np.zeros(n, np.int16)  # the last place before in b of the character of a
        for j in range(1, wb + 1):
            best = np.minimum(d[i, j] + ~same[j - 1], np.minimum(d[i, j + 1], d[i + 1, j]) + kind(1))
            k = np.flatnonzero((match > 0) & (last[j - 1] > 0))
            if len(k):
                x, y = last[j - 1, k], match[k]
                swapped = d[x, y, k].astype(np.int32) + (i - x) + (j - y) - 1
                best[k] = np.minimum(best[k], np.minimum(swapped, far))
            d[i + 1, j + 1] = best
            match[same[j - 1]] = j
        last[same] = i
    return d[(la[0] if one else la) + 1, lb + 1, rows].astype(np.int32)


def radius_pairs(strings: DataFrame, radius: int, seed: int = 7, cell: int | None = None, max_pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b, distance) of all pairs a < b of different strings within ``radius``.

    ``strings`` has the columns ``key`` (string) and, optionally, ``query`` (boolean):
    then only pairs with at least one query are returned.  Null keys are left out,
    repeated keys count once ('' is a string like others).  Pivots are a sample whose
    size is bounded by ``max_pivots`` (``cell`` strings to a pivot, if given); it decides
    how the work is divided, not what is found.  No task holds more than about ``block``
    residents and as many members at once.  An empty or single-row input gives no rows.
    """
    spark = strings.sparkSession
    mixed = "query" in strings.columns
    if not mixed:
        strings = strings.select("key", F.lit(True).alias("query"))
    base = written(strings.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max("query").alias("query")), "metric")
    n = base.count()
    if n < 2:
        return base.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0).alias("distance")).limit(0)
    wanted = int(min(max_pivots, max(1, n // cell if cell else round(n**0.5 / 8))))
    pivots = [r.key for r in base.select("key").orderBy(F.xxhash64("key", F.lit(seed))).limit(wanted).collect()]
    shared = spark.sparkContext.broadcast(encode(pivots))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, lp = shared.value
        for rows in batches:
            for lo in range(0, len(rows), PAIRS // 4):
                part = rows.iloc[lo : lo + PAIRS // 4]
                x, lx = encode(part.key.tolist())
                d = np.empty((len(part), len(lp)), np.int32)
                for k in range(len(lp)):
                    d[:, k] = distances(p[k : k + 1], lp[k : k + 1], x, lx)
                home = d.argmin(1)
                near = d[np.arange(len(part)), home]
                stays = np.arange(len(lp)) == home[:, None]
                if mixed:  # a query visits all cells, the others stay at home
                    visits = part["query"].to_numpy()[:, None] & ~stays
                else:  # of two cells the one with the smaller number sends its guest
                    visits = np.arange(len(lp)) > home[:, None]
                i, k = np.nonzero(stays | visits & (d <= near[:, None] + 2 * radius))
                yield pd.DataFrame({"key": part.key.to_numpy()[i], "query": part["query"].to_numpy()[i], "cell": k.astype(np.int32), "far": d[i, k].astype(np.int32), "home": k == home[i]})

    placed = written(spread(base, "key").mapInPandas(assign, "key string, query boolean, cell int, far int, home boolean"), "cells")
    # one row for each cell, and for each distance from a pivot: bounded by pivots and lengths, and small
    cells = placed.groupBy("cell").agg(F.max(F.when(F.col("home"), F.col("far"))).alias("reach"), F.count("*").alias("size"))
    kept = placed.join(F.broadcast(cells), "cell").filter(F.col("home") | (F.col("far") <= F.col("reach") + radius))
    small = kept.filter(F.col("size") <= block).select("cell", F.lit(-1).alias("ring"), F.lit(0).alias("i"), F.lit(0).alias("j"), "key", "query", "home", "home", F.lit(True).alias("member")).toDF("cell", "ring", "i", "j", "key", "query", "home", "resident", "member")
    large = kept.filter(F.col("size") > block).select("cell", "far", "key", "query", "home")
    within = F.explode(F.sequence(F.col("far") - radius, F.col("far") + radius)).alias("ring")
    residents = large.filter("home").withColumn("ring", F.col("far"))
    members = large.select("*", within)
    parts = residents.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block).cast("int").alias("is")).join(members.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block).cast("int").alias("js")), ["cell", "ring"])
    own = lambda n: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ("key", "query", "home")
    blocks = residents.join(parts, ["cell", "ring"]).select("cell", "ring", own("is").alias("i"), every("js").alias("j"), *row, F.lit(True).alias("resident"), F.lit(False).alias("member"))
    blocks = blocks.unionByName(members.join(parts, ["cell", "ring"]).select("cell", "ring", every("is").alias("i"), own("js").alias("j"), *row, F.lit(False).alias("resident"), F.lit(True).alias("member")))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        words = rows.key.tolist()
        x, lx = encode(words)
        bits, keys = letters(words), rows.key.to_numpy()
        asked, home = rows["query"].to_numpy(), rows.home.to_numpy()
        residents, members, out = np.flatnonzero(rows.resident.to_numpy()), np.flatnonzero(rows.member.to_numpy()), []
        members = members[np.argsort(lx[members], kind="stable")]
        step = max(1, MATRIX // max(1, len(members)))
        for lo in range(0, len(residents), step):
            some = residents[lo : lo + step]
            near = members[np.searchsorted(lx[members], lx[some].min() - radius) : np.searchsorted(lx[members], lx[some].max() + radius, "right")]
            ok = np.bitwise_count(bits[some, None] ^ bits[None, near]) <= 2 * radius
            ok &= np.abs(lx[some, None] - lx[None, near]) <= radius
            ok &= asked[some, None] | asked[None, near]
            left, right = np.nonzero(ok)
            left, right = some[left], near[right]
            once = (keys[left] < keys[right]) | ~home[right] & (keys[left] != keys[right])
            left, right = left[once], right[once]
            d = distances(x[left], lx[left], x[right], lx[right])
            hit = d <= radius
            out.append(pd.DataFrame({"a": keys[left[hit]], "b": keys[right[hit]], "distance": d[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "distance": []})

    found = written(small.unionByName(blocks).groupBy("cell", "ring", "i", "j").applyInPandas(join, "a string, b string, distance int"), "pairs")
    discard(base, placed)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()
