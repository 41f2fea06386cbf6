"""Fields that hold several values, split into one row per value.

The column is never split string by string.  A whole batch of it is scanned at once as
an array of code points: quote parity and brace depth come from running sums, delimiter
masks from comparisons, and the edges of all values of all rows from the positions where
an unprotected delimiter stands.  Whether a comma parts two names or the two halves of
one is settled for all segments together, one comma position per round.  The edges become
the offsets of a list array, which is flattened with the parents' ordinals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrowtext import code_points, text_chunks
from lectern.session import written

#: Characters that always part values outside quotes and braces.
STRONG = ";|/"
#: White space.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Words that continue a name after a comma.
SUFFIXES = {"jr", "jr.", "sr", "sr.", "jnr", "jnr.", "snr", "snr.", "ii", "iii", "iv", "2nd", "3rd"}
#: Lower-case words that open a surname.
PARTICLES = {"van", "von", "de", "del", "della", "der", "den", "di", "da", "do", "dos", "du", "la", "le", "el", "al", "af", "av", "bin", "ibn", "ter", "ten", "zu", "zur", "vom", "dei", "degli", "st.", "san"}
#: What stands for further authors without naming them.
UNNAMED = {"others", "other", "et al.", "et al", "et. al.", "et. al", "al.", "al", "et alii", "et alia", "u.a.", "u. a.", "and others", "...", "…", "etc.", "etc"}
SUFFIX, LONE, SURNAME, FULL, CLOSED, BLANK = range(6)


def _points(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, their byte positions (one more than points), and the row edges."""
    points, at = code_points(data)
    if at is None:
        return points, np.arange(len(points) + 1), offsets
    return points, at, np.searchsorted(at, offsets)


def _row_sums(values: np.ndarray, edges: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Running sums that start anew in each row, each including its own position."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[1:] - total[edges[:-1]][row]


def _any(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[edges[1:]] > total[edges[:-1]]


_SPACE_SET = "[" + "".join(f"\\x{{{c:X}}}" for c in SPACES) + "]"
_ALTERNATIVES = "(?:" + "|".join(re.escape(p) for p in sorted(PARTICLES)) + ")"
#: A surname: lower-case words, then one that is not; or particles and at most one word more.
_CASED = r"^(?:\p{Ll}\S* )+\p{Lu}\S*$"
_WITH_PARTICLES = rf"^{_ALTERNATIVES}(?: {_ALTERNATIVES})*(?: \S+(?: {_ALTERNATIVES})*)?$"
_ONLY_INITIALS = r"^(?:(?:\S|\S*\.) )*(?:\S|\S*\.)$"
_OTHERS = r"(?i)[\s,]+et al\.?$"


def _classify(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What each comma-free part of a segment can be, and whether it is initials only."""
    text = pc.utf8_trim_whitespace(pc.replace_substring_regex(parts, _SPACE_SET + "+", " "))
    low = pc.utf8_lower(text)
    match = lambda a, pattern: pc.match_substring_regex(a, pattern).to_numpy(zero_copy_only=False)
    empty = pc.equal(text, "").to_numpy(zero_copy_only=False)
    lone, initials = ~match(text, " ") & ~empty, match(text, _ONLY_INITIALS) & ~empty
    kind = np.full(len(parts), FULL)
    kind[initials] = LONE
    particle = match(low, rf"^{_ALTERNATIVES} ")
    kind[particle] = FULL
    kind[(particle & match(low, _WITH_PARTICLES)) | match(text, _CASED)] = SURNAME
    kind[lone] = LONE
    kind[lone & pc.is_in(low, pa.array(sorted(SUFFIXES))).to_numpy(zero_copy_only=False)] = SUFFIX
    kind[match(text, r'(?s)^".*"$|^\{.*\}$')] = CLOSED
    kind[empty] = BLANK
    return kind, initials


def split_column(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """Offsets (one more than rows) and names of the packed texts of a chunk."""
    points, at, edges = _points(data, offsets)
    n, rows = len(points), len(offsets) - 1
    if not n:
        return np.zeros(rows + 1, np.int64), pa.array([], pa.string())
    row = np.repeat(np.arange(rows), np.diff(edges))
    escaped = np.zeros(n, bool)
    escaped[1:] = points[:-1] == 92
    quote = (points == 34) & ~escaped
    count = np.bincount(row[quote], minlength=rows)
    quote &= (count % 2 == 0)[row]  # an unpaired quote is an ordinary character
    parity = _row_sums(quote, edges, row) % 2 == 1
    depth = _row_sums(((points == 123) & ~escaped).astype(np.int64) - ((points == 125) & ~escaped), edges, row)
    outside = ~parity & ~quote & (depth <= 0)
    space = np.isin(points, np.array(SPACES, points.dtype) if points.dtype != np.uint8 else np.array([c for c in SPACES if c < 128], np.uint8))

    strong = np.isin(points, np.array([ord(c) for c in STRONG], points.dtype)) & outside
    word_end = np.ones(n + 1, bool)  # no word goes on at this position: space, delimiter or edge
    word_end[:n] = space | strong | (points == 44) | (points == 38)
    word_end[edges] = True
    # the word "and" and the sign "&", each between spaces or delimiters
    low = np.where((points >= 65) & (points <= 90), points + 32, points)
    starts = np.zeros(n, bool)
    if n >= 3:
        begins = np.zeros(n, bool)
        begins[1:] = word_end[: n - 1] & (points[:-1] != 38)
        begins[edges[:-1][edges[:-1] < n]] = True
        starts[: n - 2] = (low[: n - 2] == 97) & (low[1 : n - 1] == 110) & (low[2:] == 100) & word_end[3 : n + 1] & begins[: n - 2]
        starts[: n - 2] &= row[: n - 2] == row[2:]
        starts &= outside
    conjunction = starts.copy()
    conjunction[1:] |= starts[:-1]
    conjunction[2:] |= starts[:-2]
    delimiter = strong | conjunction | ((points == 38) & outside & (np.concatenate([[True], space[:-1] | (points[:-1] == 44)]) | np.concatenate([space[1:], [True]])))
    # line ends and tabs part values only where nothing else does
    line = ((points == 10) | (points == 13) | (points == 9)) & outside
    delimiter |= line & ~_any(delimiter, edges)[row]

    # segments between delimiters, then parts between commas
    comma = (points == 44) & outside & ~delimiter
    cut = delimiter | comma
    stops = np.flatnonzero(cut)
    begin = np.unique(np.concatenate([edges[:-1][np.diff(edges) > 0], stops + 1]))
    begin = begin[begin < n]
    end = np.append(begin[1:], n)
    end = np.minimum(end, edges[row[begin] + 1])
    end = end - cut[end - 1]  # without the delimiter itself
    opens = np.ones(len(begin), bool)  # starts a segment (not after a comma)
    inner = begin > edges[:-1][row[begin]]
    opens[inner] = ~comma[begin[inner] - 1]
    keep = opens.copy()  # starts a name
    if comma.any():
        several = np.zeros(len(begin), bool)
        segment = np.cumsum(opens) - 1
        size = np.bincount(segment)
        several = size[segment] > 1
        index = np.flatnonzero(several)
        kind, initial = np.full(len(begin), FULL), np.zeros(len(begin) + 1, bool)
        kind[index], initial[index] = _classify(_slices(data, at[begin[index]], at[end[index]]))
        first = np.flatnonzero(opens)
        # 1: a surname waits for its given names; 2: a full name that a lone word may complete
        wait = np.zeros(len(first), np.int64)
        for k in range(int(size.max())):
            alive = np.flatnonzero(size > k)
            part = first[alive] + k
            what, state = kind[part], wait[alive]
            last = size[alive] == k + 1
            follows = initial[part + 1] & ~last & ~initial[part]
            joins = (what == SUFFIX) | ((state == 1) & (what != CLOSED)) | ((state == 2) & (what == LONE) & ~follows) | (what == BLANK)
            joins &= k > 0
            keep[part] = ~joins
            fresh = np.where((what == LONE) | (what == SURNAME), 1, np.where(what == FULL, 2, 0))
            wait[alive] = np.where((what == SUFFIX) | (what == BLANK), state, np.where(joins, 0, fresh))

    lead = np.flatnonzero(keep)
    last = np.append(lead[1:], len(begin)) - 1
    a, b, owner = begin[lead], end[last], row[begin[lead]]
    # white space and commas at the ends, then quotes or braces around the whole, inwards
    for _ in range(3):
        a, b = _trim(a, b, space | (comma & cut), n)
        wrapped = (b - a >= 2) & (((points[a % n] == 34) & (points[b - 1] == 34)) | ((points[a % n] == 123) & (points[b - 1] == 125)))
        if not wrapped.any():
            break
        index = np.flatnonzero(wrapped)
        whole = np.array([_encloses(data[at[a[i]] : at[b[i]]].decode("utf-8", "replace")) for i in index], bool)
        a[index[whole]] += 1
        b[index[whole]] -= 1
        if not whole.any():
            break
    a, b = _trim(a, b, space, n)
    some = b > a
    a, b, owner = a[some], b[some], owner[some]
    # "X et al.": the name ends before the words for the others; those alone are no name
    names = pc.replace_substring_regex(_slices(data, at[a], at[b]), _OTHERS, "")
    names = pc.utf8_trim(names, "".join(map(chr, SPACES)))
    named = ~pc.is_in(pc.utf8_lower(names), pa.array(sorted({*UNNAMED, ""}))).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(np.bincount(owner[named], minlength=rows))]), names.filter(pa.array(named))


def _slices(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """Stretches of a text's bytes as a string array, copied in one pass."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer(data, np.uint8)[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))


def _trim(a: np.ndarray, b: np.ndarray, blank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the blanks at either end; an all-blank span becomes empty."""
    solid = np.flatnonzero(~blank)
    if not len(solid):
        return a, a.copy()
    i, j = np.searchsorted(solid, a), np.searchsorted(solid, b)
    some = j > i
    first = solid[np.minimum(i, len(solid) - 1)]
    last = solid[np.maximum(j - 1, 0)] + 1
    return np.where(some, first, a), np.where(some, last, a)


def _encloses(text: str) -> bool:
    """Whether the first and last character are one pair around all the rest."""
    if text[0] == '"':
        return '"' not in text[1:-1].replace('\\"', "")
    depth = 0
    for k, c in enumerate(text):
        if k and text[k - 1] == "\\":
            continue
        depth += (c == "{") - (c == "}")
        if not depth:
            return k == len(text) - 1
    return False


def _once(pairs: DataFrame) -> DataFrame:
    """Rows of two columns without repetitions.  Only keys and fingerprints of the values
    are shuffled to find what is repeated; the values of those rows alone are compared."""
    key, value = (F.col(f"`{c}`") for c in pairs.columns)
    marked = pairs.select(key.alias("k"), value.alias("v"), F.xxhash64(value).alias("h"))
    repeated = written(marked.groupBy("k", "h").count().filter("count > 1").select(F.col("k").alias("_k"), F.col("h").alias("_h")), "repeated")
    same = F.col("k").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h"))
    some = marked.join(repeated, same, "left_semi").select("k", "v").distinct()
    return marked.join(repeated, same, "left_anti").select("k", "v").union(some).toDF(*pairs.columns)


def split_values(df: DataFrame, key_column: str, value_column: str, key_name: str | None = None, name: str = "name") -> DataFrame:
    """(key, ``pos`` from 1, ``name``): one row per value packed in ``value_column``.

    Values are parted by ``; | /``, tabs, line ends, ``&``, the word "and" and commas,
    in any mixture; quotes and braces protect what they enclose, a backslash takes the
    meaning from a quote (accents written out), an unpaired quote is a character.  A
    comma between a surname and its given names, or before a suffix like Jr., parts
    nothing.  Words for unnamed others are no value.  A value is the text as stored,
    without surrounding white space and without quotes or braces around all of it.
    Null, empty and blank fields, and those of delimiters only, give no row.  Rows equal
    in key and field count once; a null key stays null.  Other columns are not read.
    """
    key_name = key_name or key_column
    source = _once(df.select(key_column, value_column))
    schema = T.StructType([T.StructField(key_name, source.schema[key_column].dataType), T.StructField("pos", T.LongType()), T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), 1 << 18):
                offsets, values = split_column(chunk.data, chunk.offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                parent = np.repeat(np.arange(chunk.lo, chunk.hi), np.diff(offsets))
                pos = np.arange(len(values)) - np.repeat(offsets[:-1], np.diff(offsets)) + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parent)), pa.array(pos, pa.int64()), lists.flatten()], names=schema.names)

    return source.mapInArrow(run, schema)
