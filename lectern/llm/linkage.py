"""Matching records of two sources that share no key.

Probabilistic record linkage.  Several blocking passes bring candidate pairs together, each
by a key that survives one kind of difference: three of the title's longest words, or the
whole of a part of it, with an author's surname (typing errors, words or parts more or less),
the whole title or a part with a surname's and a given name's first letters (a misspelt
surname), the whole title or three
of its longest words where a side has no authors.  No key holds the year, which the sources often give
differently; parts of titles that many records share are split over tasks.  A candidate pair becomes a vector of
agreement levels of title, authors and year.  Expectation-maximisation over the counts of
all vectors estimates how often each level occurs among matches and among non-matches; the
posterior probability of a vector, shared among the papers that an entry may be, is the
confidence of its pairs, and nothing else decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrowtext import text_chunks
from lectern.functions.names import deaccent_text
from lectern.llm.characters import ALIKE, INVISIBLE
from lectern.llm.variants import _particles, _slip, parse
from lectern.operators.multivalue import split_column
from lectern.session import discard, spread, spread_thin, written

#: Least confidence of a match.
CONFIDENT = 0.9
#: Longest words of a title that its keys are made of.
TOP_WORDS = 4
#: Records of one key that meet in one task, of either side.
BLOCK = 1000
#: TeX commands for letters.
TEX_LETTERS = {"o": "o", "O": "O", "l": "l", "L": "L", "aa": "aa", "AA": "AA", "ae": "ae", "AE": "AE", "oe": "oe", "OE": "OE", "ss": "ss", "i": "i", "j": "j"}
GREEK = {unicodedata.name(chr(c)).split()[-1] for c in range(0x3B1, 0x3CA)}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_CLEAN = str.maketrans({**ALIKE, **{chr(c): None for c in INVISIBLE}})
_ACCENT = re.compile(r"\\[`'^\"~=.](?:\{\\?([A-Za-z]+)\}|\\?([A-Za-z]))|\\[cvHukrdbt](?:\{([A-Za-z]+)\}|\s+([A-Za-z]))")
_COMMAND = re.compile(r"\\([A-Za-z]+)\s?(?:\{\})?")
_MARKUP = re.compile(r"[{}$^\\]")
_BETWEEN = re.compile(r"([\W_]+)")
#: Between two words: what sets the second off from the first.
_SETS_OFF = re.compile(r"[:;,.?!()\[\]—]|\s[-–]+\s")
#: Marks in front of words.
MARKS = "|-"
#: Agreement levels of titles.
OTHER, REPLACED, CONTAINED, MORE, PART, SLIPS, SAME = range(7)
#: Numbers of agreement levels; the last one of authors and of year means a missing value.
LEVELS = {"title": 7, "authors": 5, "year": 4}
MISSING = {"title": None, "authors": 4, "year": 3}
#: What completes a part of a title to a key.
WITH_SURNAME, WITH_LETTER, WITH_LETTERS, LACKING = 1, 2, 4, 8


def plain_tex(text: str) -> str:
    """Accents and letters written as TeX commands as letters, braces and $ gone."""
    if "\\" in text:
        text = _ACCENT.sub(lambda m: next(g for g in m.groups() if g), text)
        text = _COMMAND.sub(lambda m: TEX_LETTERS.get(m[1], m[1][0] if m[1].upper() in GREEK else f" {m[1]} "), text)
    return _MARKUP.sub("", text)


def title_words(title: str | None) -> str:
    """The folded words of a title between spaces.  A word that punctuation sets off from
    what stands before it has a bar in front, one that no white space parts from it a
    hyphen.  The number of a part is in digits."""
    text = plain_tex(title or "")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_CLEAN))
        text = "".join(unicodedata.name(c).split()[-1][0].lower() if "α" <= c <= "ω" else c for c in text)
        text = deaccent_text(text)
    pieces = _BETWEEN.split(text.lower().strip())
    words: list[str] = []
    mark = ""
    for k, piece in enumerate(pieces):
        if k % 2:
            mark = "-" if not any(map(str.isspace, piece)) else "|" if _SETS_OFF.search(piece) else ""
        elif piece:
            number = ROMAN.get(piece) if len(piece) > 1 or words and words[-1].lstrip(MARKS) == "part" or k >= len(pieces) - 2 and len(words) > 1 else None
            words.append((mark if words else "") + (str(number) if number else piece))
    return " ".join(words)


def _bare(words: list[str]) -> list[str]:
    return [w.lstrip(MARKS) for w in words]


def parts(words: list[str]) -> list[list[str]]:
    """What stands before and after each mark that sets a word off."""
    return [x for k, w in enumerate(words) if w[0] == "|" for x in (words[:k], words[k:])]


def _abbreviates(short: str, long: str) -> bool:
    """Whether the letters of ``short`` stand in ``long`` in that order, its first at the start."""
    if len(short) < 2 or len(short) >= len(long) or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def _two_slips(a: str, b: str) -> bool:
    """Two edits or swaps in long names: a slip of either side."""
    n = min(len(a), len(b))
    if n < 8 or abs(len(a) - len(b)) > 2:
        return False
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    after = ((a[k + 1 :], b[k + 1 :]), (a[k + 1 :], b[k:]), (a[k:], b[k + 1 :]), (a[k + 2 :], b[k + 2 :]) if a[k : k + 2] == b[k : k + 2][::-1] else (a, b))
    return any(_slip(x, y) for x, y in after)


@lru_cache(1 << 16)
def _same_word(a: str, b: str) -> bool:
    """Equal, a slip apart, or one an abbreviation of the other; numbers only if equal."""
    if a == b:
        return True
    if a.isdigit() or b.isdigit():
        return False
    return (min(len(a), len(b)) > 3 and (_slip(a, b) or _two_slips(a, b))) or (_abbreviates(a, b) or _abbreviates(b, a))


def _stands_for(short: str, words: list[str]) -> bool:
    """Whether a word is made of others: their initials (of all, or of those of four
    letters and more), or some of their letters in order."""
    if len(short) < 2 or short[0] != words[0][0] and len(short) > len(words):
        return False
    return short in ("".join(w[0] for w in words), "".join(w[0] for w in words if len(w) > 3)) or _abbreviates(short, "".join(words))


def _aligned(a: list[str], b: list[str]) -> bool:
    """Whether the words of two lists are the same in order, some of them abbreviated."""
    i = j = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x == y:
            i, j = i + 1, j + 1
            continue
        step = None
        if x.startswith(y):
            step = next(((1, k) for k in range(2, 5) if x == "".join(b[j : j + k])), None)
        elif y.startswith(x):
            step = next(((k, 1) for k in range(2, 5) if y == "".join(a[i : i + k])), None)
        step = step or ((1, 1) if _same_word(x, y) else None)
        step = step or next((t for k in range(2, 5) for t, ok in (((1, k), _stands_for(x, b[j : j + k])), ((k, 1), _stands_for(y, a[i : i + k]))) if ok), None)
        if not step:
            return False
        i, j = min(i + step[0], len(a)), min(j + step[1], len(b))
    return i == len(a) and j == len(b)


def _numbers(words: list[str]) -> list[str]:
    """The numbers at the ends of a title's parts."""
    return [w.lstrip(MARKS) for k, w in enumerate(words) if w[-1].isdigit() and w.lstrip(MARKS).isdigit() and w[0] != "-" and (k == len(words) - 1 or words[k + 1][0] == "|")]


def title_level(x: str, y: str) -> int:
    """How far two titles, as :func:`title_words` gives them, agree.

    SAME words; only SLIPS, abbreviations and other hyphens; one has a PART more that
    punctuation sets off at either end; one has one word MORE; one is CONTAINED in the
    other at its start or end, and no shorter than half of it; one word is REPLACED by
    another; OTHER words or numbers."""
    if not x or not y:
        return OTHER
    a, b = x.split(" "), y.split(" ")
    if x == y or _bare(a) == _bare(b):
        return SAME
    if _numbers(a) != _numbers(b):
        return OTHER
    short = min(len(a), len(b))
    if short > 3 and 2 * len(set(_bare(a)) & set(_bare(b))) < short:
        return OTHER
    level = _words_level(a, b)
    if level < PART:
        for whole, other in ((a, b), (b, a)):
            if any(len(part) > 1 and _numbers(part) == _numbers(whole) and _words_level(part, other, SLIPS) >= SLIPS for part in parts(whole)):
                return PART
    return level


def _words_level(x: list[str], y: list[str], least: int = OTHER) -> int:
    """The level of two lists of words, a section not being looked for; one below ``least`` may be given as OTHER."""
    a, b = _bare(x), _bare(y)
    if a == b or "".join(a) == "".join(b):
        return SAME if a == b else SLIPS
    k, n = 0, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    e = 0
    while e < n - k and a[-1 - e] == b[-1 - e]:
        e += 1
    u, v = a[k : len(a) - e], b[k : len(b) - e]  # what differs
    one = lambda w: all(z[0] == "-" for z in w[k + 1 : len(w) - e])  # noqa: E731  no white space inside
    if not u or not v:
        return MORE if one(x) and one(y) else CONTAINED if n > 2 and 2 * n >= max(len(a), len(b)) and not (k and e) else OTHER
    p, q = "".join(u), "".join(v)
    if (not any(w.isdigit() for w in u + v) and (_slip(p, q) or _two_slips(p, q))) or _aligned(u, v):
        return SLIPS
    if least == SLIPS and sorted(a) != sorted(b):  # only the same words in another order are left
        return OTHER
    if abs(len(u) - len(v)) == 1:
        long, short = (u, v) if len(u) > len(v) else (v, u)
        if any(_aligned(long[:i] + long[i + 1 :], short) for i in range(len(long))):
            return MORE
    if one(x) and one(y) or len(u) == len(v) and sum(not _same_word(s, t) for s, t in zip(u, v)) == 1:
        return REPLACED
    left, right = Counter(a), Counter(b)
    both = sum((left & right).values())
    moved = (len(a) - both, len(b) - both)
    return (SLIPS, MORE, REPLACED)[sum(moved)] if max(moved) < 2 else OTHER


def year_of(value: object) -> int:
    found = re.search(r"(?:1[5-9]|20)\d\d", str(value if value is not None else ""))
    return int(found[0]) if found else 0


@lru_cache(1 << 16)
def _person(name: str) -> tuple[str, str, str] | None:
    plain = plain_tex(name)
    p = parse(plain)
    particle = _particles(plain)  # some sources leave them out
    bare = lambda s, q=particle: s[len(q) :] if q and s.startswith(q) and len(s) > len(q) + 2 else s
    if p["shape"] == "full":
        surname = bare(p["surname"] or "".join(p["words"][1:]))
        return surname, p["head"][:1], "" if p["fixed"] else p["words"][-1] if len(p["words"]) > 2 else p["head"]
    return (bare(p["surname"]), p["head"][:1], "") if p["surname"] else None


def people(names: list[str]) -> list[tuple[str, str, str]]:
    """(surname, given initial, what else the surname may be) of each name: the first word
    of two, if they stand the other way round; the last of more; '' where the form of the
    name settles it."""
    return [p for p in map(_person, names) if p]


@lru_cache(1 << 16)
def _tag(text: str) -> int:
    return (xxhash.xxh3_64_intdigest(text) & 0xFFFFFFFF) - (1 << 31)


def blocking_keys(title: str, persons: list[tuple[str, str, str]], paper: bool) -> list[tuple[int, int, list[int]]]:
    """The keys of all passes: hashes of parts of the title, each with the hashes of what
    else of the record may complete it to a key, and these as bits of a word.  Two records
    share a key where they share a part and one of its completions."""
    marked = title.split()
    if not marked:
        return []
    whole = "".join(_bare(marked))
    # hyphenated words are one: some sources print them so
    units = lambda part: set(" ".join(part).replace(" -", "").replace("|", "").lstrip(MARKS).split(" "))
    longest = lambda part, n: sorted(sorted(sorted(units(part)), key=len, reverse=True)[:n])
    top = longest(marked, TOP_WORDS)
    kinds = {whole: WITH_SURNAME | WITH_LETTER | WITH_LETTERS | LACKING}
    for g in combinations(top, min(3, max(1, len(top) - 1))):
        kinds[x] = kinds.get(x := " ".join(g), 0) | WITH_SURNAME
    for part in parts(marked):
        kinds[x] = kinds.get(x := "".join(_bare(part)), 0) | WITH_SURNAME | WITH_LETTERS
        kinds[x] = kinds.get(x := " ".join(longest(part, 3)), 0) | WITH_SURNAME
    for g in combinations(top, 3):
        kinds[x] = kinds.get(x := " ".join(g), 0) | LACKING
    surnames = {s for s, _, _ in persons}
    if len(persons) == 1:  # a lone name may stand the other way round
        surnames |= {h for _, _, h in persons if h}
    # a side without authors meets all records of the other with that title
    lacking, other = ("p", "e") if paper else ("e", "p")
    completions = (
        (WITH_SURNAME, [_tag("s|" + s) for s in surnames]),
        (WITH_LETTER, [_tag("f|" + x) for x in {s[:1] for s in surnames}]),
        (WITH_LETTERS, [_tag(f"i|{s}|{i}") for s, i in {(s[:1], i) for s, i, _ in persons}]),
        (LACKING, [_tag(other)] if surnames else [_tag(other), _tag(lacking)]),
    )
    made: dict[int, tuple[int, list[int]]] = {}
    out = []
    for text, kind in kinds.items():
        if kind not in made:
            tags = [x for k, own in completions if kind & k for x in own]
            bits = 0
            for x in tags:
                bits |= 1 << (x & 63)
            made[kind] = (bits - (1 << 64) if bits >> 63 else bits, tags)
        if made[kind][1]:
            out.append((xxhash.xxh3_64_intdigest(text) - (1 << 63), *made[kind]))
    return out


def same_person(a: tuple[str, str, str], b: tuple[str, str, str]) -> bool:
    """Surnames equal or one slip apart, initials not against it; or the parts of one
    stand the other way round."""
    if a[0] == b[0] or (min(len(a[0]), len(b[0])) > 3 and (_slip(a[0], b[0]) or _two_slips(a[0], b[0]))):
        return not a[1] or not b[1] or a[1] == b[1] or a[0] == b[0] and len(a[0]) > 3
    turned = lambda x, y: len(x[2]) > 3 and _slip(x[2], y[0]) and (not y[1] or y[1] in (x[0][:1], x[1]))
    return turned(a, b) or turned(b, a)


def authors_level(a: list[tuple[str, str, str]], b: list[tuple[str, str, str]]) -> int:
    """3: all of the shorter list; 2: at least half; 1: at least one; 0: none; 4: missing."""
    if not a or not b:
        return 4
    if a == b:
        return 3
    short, long = (a, list(b)) if len(a) <= len(b) else (b, list(a))
    hits = 0
    for person in short:
        for k, other in enumerate(long):
            if same_person(person, other):
                hits += 1
                del long[k]
                break
    return 0 if not hits else 3 if hits == len(short) else 2 if 2 * hits >= len(short) else 1


def year_level(a: int, b: int) -> int:
    """2: equal; 1: next to each other; 0: apart; 3: missing."""
    return 3 if not a or not b else 2 if a == b else 1 if abs(a - b) == 1 else 0


_FEATURES = T.StructType([T.StructField("rec", T.StringType()), T.StructField("title", T.StringType()), T.StructField("people", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("surnames", T.ArrayType(T.StringType())), T.StructField("content", T.BinaryType()), T.StructField("raw", T.BinaryType())])
_KEYS = "rec {}, key long, bits long, tags array<int>"


def _source(records: DataFrame, key: str, title: str, authors: str, year: str) -> DataFrame:
    """What is read of each record, nulls as empty texts, and ``raw``, which is equal where
    these texts are."""
    texts = {"title": title, "authors": authors, "year": year}
    source = records.select(F.col(key).cast("string").alias("rec"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in texts.items()]).filter(F.col("rec").isNotNull())
    sized = F.concat_ws(" ", *[F.length(n) for n in texts], *texts)
    return source.withColumn("raw", F.unhex(F.md5(sized)))


def features(records: DataFrame, key: str, title: str, authors: str, year: str, paper: bool) -> DataFrame:
    """What the comparison needs of each record; ``content`` is equal where all that is
    compared is."""
    return _features(spread_thin(_source(records, key, title, authors, year)))


def read_once(source: DataFrame) -> DataFrame:
    """One record of each that differ in no text, the one with the smallest key, over all
    cores: texts are taken apart once, however many records repeat them."""
    texts = [c for c in source.columns if c != "rec"]
    return spread(source, "raw").groupBy(*texts).agg(F.min("rec").alias("rec"))


def _features(source: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            packed: list[list[str]] = []
            for chunk in text_chunks(batch.column(2), 1 << 18):
                offsets, names = split_column(chunk.data, chunk.offsets)
                flat = names.to_pylist()
                packed += [flat[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)]
            out = []
            for rec, title_, names, year_, raw in zip(rows["rec"], rows["title"], packed, rows["year"], rows["raw"]):
                words, persons, y = title_words(title_), people(names), year_of(year_)
                them = ";".join(map(",".join, persons))
                out.append((rec, words, them, y, sorted({s for s, _, _ in persons}), xxhash.xxh3_128_digest(f"{words}\n{them}\n{y}"), raw))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], schema=pa.schema(list(zip(_FEATURES.names, arrow))))

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_FEATURES).types
    return source.select("rec", "title", "authors", "year", "raw").mapInArrow(run, _FEATURES)


def distinct_features(records: DataFrame) -> DataFrame:
    """One record of each that differ in nothing compared, the one with the smallest key.
    Copies behave alike, so only their representatives meet."""
    rest = [c for c in records.columns if c not in ("content", "raw")]
    return records.groupBy("content").agg(F.min_by(F.struct(*rest), "rec").alias("x")).select("content", "x.*")


def keys_of(records: DataFrame, paper: bool) -> DataFrame:
    """One row per record and part of its title that is part of a key."""
    kind = records.schema["rec"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, them = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo in range(0, batch.num_rows, 2000):
                at, keys, bits, tags, ends = [], [], [], [], [0]
                for k in range(lo, min(lo + 2000, batch.num_rows)):
                    for key, word, own in blocking_keys(titles[k], _split(them[k]), paper):
                        at.append(k)
                        keys.append(key)
                        bits.append(word)
                        tags += own
                        ends.append(len(tags))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tags, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.int64()), pa.array(bits, pa.int64()), lists], names=["rec", "key", "bits", "tags"])

    return spread_thin(records.select("rec", "title", "people")).mapInArrow(run, _KEYS.format(kind.simpleString()))


def candidates(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of records that share a key of some pass.  The rows of a part of a title meet
    in one place and are paired where a completion is shared too.  Of a part with more than
    ``block`` records on a side, every share of about that many meets every share of the
    other side in a task of its own."""
    x, y = written(keys_of(a, True), "keys"), written(keys_of(b, False), "keys")
    counts = x.select("key", F.lit(1).alias("n"), F.lit(0).alias("m")).unionAll(y.select("key", F.lit(0), F.lit(1))).groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    part = lambda c: F.ceil(F.col(c) / block).cast("int")
    hot = written(counts.filter(F.greatest("n", "m") > block).filter(F.least("n", "m") > 0).select("key", part("n").alias("is"), part("m").alias("js")), "hot")
    left = x.select("key", F.col("rec").alias("rec_a"), F.col("bits").alias("bits_a"), F.col("tags").alias("tags_a"))
    right = y.select("key", F.col("rec").alias("rec_b"), F.col("bits").alias("bits_b"), F.col("tags").alias("tags_b"))
    on = ["key"]
    if not hot.isEmpty():
        own = lambda c, n: F.coalesce(F.pmod(F.xxhash64(c), F.col(n)).cast("int"), F.lit(0))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
        left = left.join(hot, "key", "left").select(*left.columns, own("rec_a", "is").alias("i"), every(F.col("js")).alias("j"))
        right = right.join(hot, "key", "left").select(*right.columns, every(F.col("is")).alias("i"), own("rec_b", "js").alias("j"))
        on = ["key", "i", "j"]
    met = left.join(right, on).filter((F.col("bits_a").bitwiseAND(F.col("bits_b")) != 0) & F.arrays_overlap("tags_a", "tags_b"))
    out = written(met.select("rec_a", "rec_b").distinct(), "pairs")
    discard(x, y, hot)
    return out


@lru_cache(1 << 14)
def _split(them: str) -> list[tuple[str, str, str]]:
    return [tuple(p.split(",")) for p in them.split(";")] if them else []


def compared(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """The agreement levels of each pair, with the ``name`` of the first record if it has one."""
    own = [c for c in ("name",) if c in a.columns]
    side = lambda df, s, *more: df.select(*[F.col(c).alias(c + s) for c in ("rec", "title", "people", "year", *more)])
    joined = pairs.join(side(a, "_a", *own), "rec_a").join(side(b, "_b"), "rec_b")
    fields = [*[T.StructField(c, pairs.schema[c].dataType) for c in ("rec_a", "rec_b")], *[T.StructField(c + "_a", T.StringType()) for c in own], *[T.StructField(x, T.IntegerType()) for x in (*LEVELS, "gap")]]

    asked = [c + s for s in ("_a", "_b") for c in ("title", "people", "year")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = {c: batch.column(c).to_pylist() for c in asked}
            levels = [
                (title_level(x, y), authors_level(_split(p), _split(q)), year_level(ya, yb), abs(ya - yb) if ya and yb else 99)
                for x, p, ya, y, q, yb in zip(*[r[c] for c in asked])
            ]
            columns = list(zip(*levels)) if levels else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields[: len(fields) - len(columns)]], *[pa.array(c, pa.int32()) for c in columns]], names=[f.name for f in fields])

    return joined.mapInArrow(run, T.StructType(fields))


def pairs_outside(a: DataFrame, b: DataFrame, counted: dict[tuple[int, int, int], int]) -> list[tuple[tuple[int, int, int], float]]:
    """Level vectors of the pairs that no pass brought together, with their numbers.

    Over all pairs, the levels of year follow from the numbers of records by year, those
    and those of authors from the numbers of records by surname and by how many authors
    they have; the pairs that were compared are taken off.  Years are taken to be
    independent of the rest, the titles to be OTHER ones: the few pairs of one title by
    other people would say of the same people, wrongly, that they use a title twice."""
    years = lambda df: {r["year"]: r["count"] for r in df.groupBy("year").count().collect()}  # noqa: E731  one row per year
    years_a, years_b = years(a), years(b)
    total = float(sum(years_a.values())) * float(sum(years_b.values()))
    if total <= sum(counted.values()):
        return []
    by_year = np.zeros(LEVELS["year"])
    for x, n in years_a.items():
        for y, m in years_b.items():
            by_year[year_level(x, y)] += float(n) * m / total
    known = lambda df: df.agg(F.count_if(F.size("surnames") > 0)).first()[0]
    both = float(known(a)) * float(known(b))
    size = F.least(F.size("surnames"), F.lit(3))
    names = lambda df, s: df.select(F.explode("surnames").alias("surname"), size.alias("k" + s)).groupBy("surname", "k" + s).agg(F.count("*").cast("double").alias("n" + s))
    sharing = names(a, "_a").join(names(b, "_b"), "surname").groupBy(F.least("k_a", "k_b").alias("k")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n")).collect()  # at most three rows
    by_authors = np.zeros(LEVELS["authors"])
    for row in sharing:  # one of one, of two, of more
        by_authors[{1: 3, 2: 2}.get(row["k"], 1)] += min(row["n"], both)
    by_authors[MISSING["authors"]] = total - both
    by_authors[0] = max(both - by_authors[1:4].sum(), 0)
    seen = lambda k, level: sum(n for v, n in counted.items() if v[k] == level)
    rest = np.array([max(by_authors[k] - seen(1, k), 0.0) for k in range(LEVELS["authors"])])
    out = [((OTHER, k, y), n * share) for k, n in enumerate(rest) for y, share in enumerate(by_year) if n * share > 0]
    return out


def expectation_maximisation(levels: np.ndarray, counts: np.ndarray, sizes: tuple[int, ...], rounds: int = 200, missing: tuple[int | None, ...] = ()) -> np.ndarray:
    """Posterior match probability of each level vector."""
    return 1 / (1 + np.exp(-log_odds(levels, counts, sizes, rounds, missing)))


def log_odds(levels: np.ndarray, counts: np.ndarray, sizes: tuple[int, ...], rounds: int = 200, missing: tuple[int | None, ...] = (), most: float = np.inf) -> np.ndarray:
    """The logarithm of the posterior odds of each level vector, by expectation-maximisation.

    Starts from the belief that the higher level is the likelier among matches, and that a
    ``missing`` one says nothing; each round weighs every vector by its current posterior and re-estimates the share of
    matches and the level frequencies of both classes, with a small pseudo-count.  There are
    at ``most`` so many matches, where that is known."""
    if not len(counts):
        return np.zeros(0)
    if not counts.sum():
        return np.full(len(counts), -500.0)
    fields = range(levels.shape[1])
    m = [np.array([4.0**k for k in range(n)]) for n in sizes]
    u = [np.array([4.0**-k for k in range(n)]) for n in sizes]
    for x, y, level in zip(m, u, missing):
        if level is not None:
            x[level], y[level] = x[:level].sum() / 10, y[:level].sum() / 10
    m, u = [x / x.sum() for x in m], [x / x.sum() for x in u]
    share, posterior, odds = min(1e-4, most / counts.sum()), np.zeros(len(counts)), np.zeros(len(counts))
    for _ in range(rounds):
        a, b = np.log(share), np.log1p(-share)
        la = a + sum(np.log(m[k][levels[:, k]]) for k in fields)
        lb = b + sum(np.log(u[k][levels[:, k]]) for k in fields)
        odds = np.clip(la - lb, -500, 500)
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
        share = float(np.clip(min((counts * posterior).sum(), most) / counts.sum(), 1e-15, 1 - 1e-6))
        for k, n in zip(fields, sizes):
            wm = np.bincount(levels[:, k], counts * posterior, n) + 0.01
            wu = np.bincount(levels[:, k], counts * (1 - posterior), n) + 0.01
            m[k], u[k] = wm / wm.sum(), wu / wu.sum()
    return odds


def link_works(papers: DataFrame, entries: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(paper_id, bib_key, confidence): the entries and the paper each is the same work as.

    ``papers`` has id, title, authors, year; ``entries`` has key, title, author, year.  An
    entry has at most one paper: of those more probable than not, one whose title agrees
    best, and of these the most probable, then the nearest in year, then the smallest id.
    Its confidence is its odds in the sum of the odds of all papers with so good a title,
    and of none; a match needs the confidence given.  So where nothing tells which of
    several papers is meant there is no match.  Records without a title match
    nothing; missing authors or years are a level of their own, and weigh what the data
    show them to weigh.  Papers that differ in nothing compared are one, with the smallest
    id; entries that differ in nothing compared get the same paper; neither kind of copy
    is expanded into pairs.  Null and repeated keys: rows with a null key are left out,
    full duplicates count once.  Empty tables give no rows.  Other columns are not read.
    """
    spark = papers.sparkSession
    all_b = written(_features(read_once(_source(entries, "key", "title", "author", "year"))), "entries")
    known_a = distinct_features(_features(read_once(_source(papers, "id", "title", "authors", "year"))))
    numbered = lambda df: df.withColumnRenamed("rec", "name").withColumn("rec", F.monotonically_increasing_id())
    a, b = written(numbered(known_a), "papers"), written(numbered(distinct_features(all_b)), "entries")
    pairs = candidates(a, b)
    levels = written(compared(a, b, pairs), "levels")
    names = list(LEVELS)
    counted = {tuple(r[n] for n in names): r["count"] for r in levels.groupBy(*names).count().collect()}  # at most one row per vector of levels
    # the pairs outside the blocks are non-matches by far; they enter as counts
    outside = pairs_outside(a, b, counted)
    vectors = np.array([*counted, *(v for v, _ in outside)], np.int64).reshape(-1, len(names))
    counts = np.array([*counted.values(), *(n for _, n in outside)], float)
    odds = log_odds(vectors, counts, tuple(LEVELS.values()), missing=tuple(MISSING.values()), most=float(b.count()))[: len(counted)]
    rows = [(*v, float(np.exp(o))) for v, o in zip(counted, odds)]
    table = spark.createDataFrame(rows, T.StructType([*[T.StructField(n, T.IntegerType()) for n in names], T.StructField("odds", T.DoubleType())]))
    judged = levels.join(F.broadcast(table), names)
    alike = judged.groupBy("rec_b", "title").agg(F.min_by(F.struct("name_a", "odds"), F.struct(-F.col("odds"), F.col("gap"), F.col("name_a"))).alias("x"), F.sum("odds").alias("all")).filter("x.odds > 1")
    best = alike.groupBy("rec_b").agg(F.max_by(F.struct("x.*", "all"), "title").alias("x")).select("rec_b", F.col("x.name_a").alias("paper_id"), (F.col("x.odds") / (1 + F.col("x.all"))).alias("confidence"))
    sure = best.filter(F.col("confidence") >= confident)
    chosen = sure.join(b.select(F.col("rec").alias("rec_b"), "content"), "rec_b").join(all_b.select("content", "raw"), "content")
    keys = _source(entries, "key", "title", "author", "year").select("raw", F.col("rec").alias("bib_key"))
    out = written(chosen.join(keys, "raw").select("content", "paper_id", "bib_key", "confidence").distinct().drop("content"), "matches")
    discard(all_b, a, b, pairs, levels)
    return out
