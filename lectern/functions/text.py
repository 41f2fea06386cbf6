"""Analysing text for search.

A searchable column gets an analysed twin: its tokens, one space between them and one at
either end.  A term is then ``contains(' t ')``, a prefix ``contains(' t')``, a phrase
``contains(' a b ')``, all plain string expressions that Catalyst compiles.  Tokens are
runs of letters and digits, lower case, accents of Latin letters off.  Stemming is the one
step in Python, over Arrow batches of the analysed columns alone: filters on other columns
run before it and reach the scan, and columns nobody asks for are not read.  It belongs to
ingest: write the analysed table once and search that.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.porter import stem


def _simple_accents() -> dict[str, str]:
    """Lower-case letters that are a base letter and one accent.  Letters with a stroke
    or a second accent are letters of their own for the index."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        low = c.lower()
        if len(low) != 1:
            continue
        parts = unicodedata.normalize("NFD", low)
        if len(parts) == 2 and parts[0].isascii():
            out[low] = parts[0]
    return out


ACCENTS = _simple_accents()
_FROM, _TO = "".join(ACCENTS), "".join(ACCENTS.values())
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"
_TOKENS_TEXT = re.compile(r"[\W_]+")


def tokens_string(text: Column | str) -> Column:
    """The tokens of a text between single spaces, one at either end; ' ' if none."""
    c = F.col(text) if isinstance(text, str) else text
    plain = F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}", ""), _FROM, _TO)
    spaced = F.trim(F.regexp_replace(plain, SEPARATORS, " "))
    return F.when(spaced == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), spaced, F.lit(" ")))


def tokens_of(text: str) -> list[str]:
    """The same for one string, such as a query term."""
    plain = "".join(c for c in text.lower() if unicodedata.category(c) != "Mn")
    return "".join(ACCENTS.get(c, c) if c.isalnum() or unicodedata.category(c) in ("Nl", "No", "Co") else " " for c in plain).split()


def stems_of(text: str) -> list[str]:
    return [stem(t) for t in tokens_of(text)]


def stemmed_column(tokens: Column | str) -> Column:
    """A string of tokens with each one's stem in its place; the rest of a row stays in the JVM."""
    run = F.pandas_udf(lambda values: values.map(lambda v: None if v is None else " ".join(map(stem, v.split(" ")))), T.StringType())
    return run(F.col(tokens) if isinstance(tokens, str) else tokens)


def analyse(df: DataFrame, columns: dict[str, str], stemmed: bool = True) -> DataFrame:
    """``df`` with an analysed column for each of ``columns`` (source: analysed name).

    Null text gives null, which no term matches; '' gives ' '.  Repeated analysis is
    harmless: an analysed column of the same name is replaced.
    """
    out = df.withColumns({target: tokens_string(source) for source, target in columns.items()})
    if not stemmed:
        return out
    return out.withColumns({target: stemmed_column(target) for target in columns.values()})


# -- marking matches -------------------------------------------------------------------

OPEN, CLOSE = "\x01", "\x02"


def mark_words(text: Column | str, words: list[str], prefix: bool = False) -> Column:
    """Occurrences of unstemmed words between ``\\x01`` and ``\\x02``, inside the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    if not words:
        return c
    alternatives = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    end = r"[\p{L}\p{N}]*" if prefix else r"(?![\p{L}\p{N}])"
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}])((?:{alternatives}){end})", f"{OPEN}$1{CLOSE}")


def mark_phrases(phrases: list[tuple[list[str], bool]], stemmed: bool = True):
    """A function that marks phrases (stems, last is a prefix) in one text: a phrase is
    one span, adjacent spans of different phrases stay apart, overlapping ones merge."""
    word = re.compile(r"[^\W_]+[̀-ͯ]*(?:[^\W_]|[̀-ͯ])*")

    def mark(text: str | None) -> str | None:
        if not text or not phrases:
            return text
        found = [(m.start(), m.end(), (tokens_of(m[0]) or [""])[0]) for m in word.finditer(text)]
        stems = [stem(t) if stemmed else t for _, _, t in found]
        spans: list[list[int]] = []
        hits = []
        for terms, prefix in phrases:
            n = len(terms)
            for i in range(len(stems) - n + 1):
                if stems[i : i + n - 1] == terms[:-1] and (stems[i + n - 1].startswith(terms[-1]) if prefix else stems[i + n - 1] == terms[-1]):
                    hits.append((i, i + n - 1))
        for a, b in sorted(hits):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        out, at = [], 0
        for a, b in spans:
            out += [text[at : found[a][0]], OPEN, text[found[a][0] : found[b][1]], CLOSE]
            at = found[b][1]
        return "".join([*out, text[at:]])

    return mark
