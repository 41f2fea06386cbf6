"""Person names: folding, skeletons, matching.

Everything that runs over data is a Column expression.  ``*_text`` functions do the same
to one Python string, for query terms and curated tables on the driver.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that stand for two.
LIGATURES = {"æ": "ae", "œ": "oe", "ß": "ss"}
#: Letters with a stroke, which do not decompose.
STROKES = {"ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t"}


def _base_letters() -> dict[str, str]:
    """Lower-case letters of Latin-1 and Latin Extended-A and what they fold to."""
    out = dict(STROKES)
    for c in map(chr, range(0xC0, 0x180)):
        low = c.lower()
        parts = unicodedata.normalize("NFD", low)
        if len(low) == 1 and low.isalpha() and low not in LIGATURES and low not in out and len(parts) > 1:
            out[low] = parts[0]
    return out


BASE = _base_letters()
#: The same in both cases, for text that keeps its case.
BASE_CASED = BASE | {a.upper(): b.upper() for a, b in BASE.items() if len(a.upper()) == 1}
LIGATURES_CASED = {**LIGATURES, "Æ": "AE", "Œ": "OE"}
DIGRAPHS = r"(a)a|(o)e|(u)e(?=\p{IsAlphabetic})"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mapped(column: Column, table: dict[str, str]) -> Column:
    return F.translate(column, "".join(table), "".join(table.values()))


def ascii_fold(name: Column | str) -> Column:
    """Lower case, accents off, runs of anything but letters and digits one space."""
    out = _mapped(F.regexp_replace(F.lower(_column(name)), r"[\x{300}-\x{36F}]", ""), BASE)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"[^\p{IsAlphabetic}\p{N}]+", " "))


def collapse_digraphs(folded: Column | str) -> Column:
    """``aa``, ``oe`` and, before a letter, ``ue`` as one vowel, left to right once."""
    return F.regexp_replace(_column(folded), DIGRAPHS, "$1$2$3")


def fold_name(name: Column | str) -> Column:
    return collapse_digraphs(ascii_fold(name))


def skeleton(folded: Column | str) -> Column:
    """A folded name without initials and spaces."""
    return F.array_join(F.filter(F.split(_column(folded), " "), lambda w: F.length(w) > 1), "")


def deaccent(text: Column | str) -> Column:
    """Accents off, case and punctuation kept, letter by letter."""
    out = F.regexp_replace(_column(text), r"[\x{300}-\x{36F}]", "")
    out = _mapped(out, BASE_CASED)
    for a, b in LIGATURES_CASED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def byline_names(byline: Column | str) -> Column:
    """The names of a ``;``-separated byline, spacing tidied, blanks dropped."""
    parts = F.transform(F.split(_column(byline), ";"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.filter(parts, lambda x: x != "")


def author_match(byline: Column | str, needle: str) -> Column:
    """Whether one author of the byline has every word of ``needle`` as the start of one
    of their words, in any order; initials in the needle are ignored.  A needle without
    longer words must occur literally in the folded byline."""
    folded = fold_text(needle)
    words = [w for w in folded.split() if len(w) > 1]
    if not words:
        return F.contains(fold_name(byline), F.lit(folded)) if folded else F.lit(False)
    authors = F.transform(F.split(_column(byline), ";"), lambda a: F.split(fold_name(a), " "))

    def has(author: Column, word: str) -> Column:
        return F.exists(author, lambda part: F.startswith(part, F.lit(word)))

    def has_all(author: Column) -> Column:
        out = has(author, words[0])
        for w in words[1:]:
            out = out & has(author, w)
        return out

    return F.exists(authors, has_all)


def split_surname(name: Column | str) -> Column:
    """struct(rest, surname): the last word apart; null for a single word."""
    words = F.split(F.trim(_column(name)), r"\s+")
    n = F.size(words)
    return F.when(n > 1, F.struct(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), " ").alias("rest"), F.element_at(words, -1).alias("surname")))


def person_form_column(name: Column | str) -> Column:
    """"Last, First" with one comma and both sides as "First Last", others as they are."""
    parts = F.split(_column(name), ",")
    last, first = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & (last != "") & (first != ""), F.concat_ws(" ", first, last)).otherwise(_column(name))


# -- the same for one string -----------------------------------------------------------

_DIGRAPH_TEXT = re.compile(r"(a)a|(o)e|(u)e(?=[^\W\d_])")
_OTHER = re.compile(r"[\W_]+")


def ascii_fold_text(name: str) -> str:
    out = name.lower()
    if not out.isascii():
        out = re.sub("[̀-ͯ]", "", out)
        out = "".join(LIGATURES.get(c) or BASE.get(c, c) for c in out)
    return _OTHER.sub(" ", out).strip()


def collapse_text(folded: str) -> str:
    return _DIGRAPH_TEXT.sub(lambda m: m[1] or m[2] or m[3], folded)


def fold_text(name: str) -> str:
    return collapse_text(ascii_fold_text(name))


def skeleton_text(folded: str) -> str:
    return "".join(w for w in folded.split() if len(w) > 1)


def person_form_text(name: str) -> str:
    parts = [p.strip() for p in name.split(",")]
    return f"{parts[1]} {parts[0]}" if len(parts) == 2 and all(parts) else name


def deaccent_text(text: str) -> str:
    return "".join(LIGATURES_CASED.get(c) or BASE_CASED.get(c, c) for c in re.sub("[̀-ͯ]", "", text))
