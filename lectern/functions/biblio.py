"""Titles, bylines, licences and identifiers of papers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_title(text: Column | str) -> Column:
    """ASCII letters and digits in lower case, single spaces for all else; TeX commands
    count as a space."""
    plain = F.regexp_replace(_c(text), r"\\[A-Za-z]*", " ")
    return F.trim(F.lower(F.regexp_replace(plain, r"[^A-Za-z0-9]+", " ")))


def surnames(authors: Column | str) -> Column:
    """The normalised surnames of an ``and``-separated list: what stands before the first
    comma, else the last word."""
    names = F.transform(F.split(_c(authors), " and "), lambda n: F.regexp_replace(n, r"^\s+|\s+$", ""))
    last = lambda n: F.when(F.contains(n, F.lit(",")), F.substring_index(n, ",", 1)).otherwise(F.element_at(F.split(n, r"\s+"), -1))
    return F.filter(F.transform(names, lambda n: norm_title(last(n))), lambda s: s != "")


def paper_id_in(text: Column | str) -> Column:
    """The first ``dddd/d+`` in a text; null if there is none."""
    found = F.regexp_extract(_c(text), r"(\d{4}/\d+)", 1)
    return F.when(found != "", found)


def is_paper_id(text: Column | str) -> Column:
    return _c(text).rlike(r"^[0-9]{4}/[0-9]+\z")


def normal_id(text: Column | str, this_year: int) -> Column:
    """An id as stored: site address, white space and ``.pdf`` gone; a bare number is of
    this year."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(_c(text)), r"^https?://[^/]+/", ""), r"\.pdf$", "")
    return F.when(bare.rlike(r"^\d+\z"), F.concat(F.lit(f"{this_year:04d}/"), bare)).otherwise(bare)


def split_id(text: Column | str) -> Column:
    """struct(year, number) of ``YYYY/N`` or ``YYYY-N...``; null for anything else."""
    c = _c(text)
    year, number = (F.regexp_extract(c, r"^(\d{4})[/-](\d{1,9})", k) for k in (1, 2))
    return F.when(year != "", F.struct(year.cast("int").alias("year"), number.cast("int").alias("number")))


def byline_array(byline: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(byline), ";"), lambda a: F.trim(a)), lambda a: a != "")


def _surname(name: Column) -> Column:
    words = F.filter(F.split(name, r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    return F.when(F.size(words) > 0, F.element_at(words, -1)).otherwise(name)


def short_authors(byline: Column | str, favourite: str | None = None) -> Column:
    """Surnames of up to three authors; of more the first two, the favourite if it is
    further on, and "et al."; a dash for nobody."""
    names = byline_array(byline)
    last = F.transform(names, _surname)
    extra = F.filter(F.slice(names, 3, F.greatest(F.size(names) - 2, F.lit(1))), lambda n: F.contains(F.lower(n), F.lit(favourite.lower()))) if favourite else F.array().cast("array<string>")
    picked = F.concat(F.slice(last, 1, 2), F.slice(F.transform(extra, _surname), 1, 1))
    return F.when(F.size(names) == 0, F.lit("—")).when(F.size(names) <= 3, F.array_join(last, ", ")).otherwise(F.concat(F.array_join(picked, ", "), F.lit(" et al.")))


def full_authors(byline: Column | str) -> Column:
    names = byline_array(byline)
    return F.when(F.size(names) == 0, F.lit("—")).otherwise(F.array_join(names, ", "))


def has_author(byline: Column | str, part: str) -> Column:
    """Whether one author contains the text, in any case."""
    return F.exists(F.split(_c(byline), ";"), lambda a: F.contains(F.lower(a), F.lit(part.lower())))


def short_license(rights: Column | str) -> Column:
    """Creative Commons addresses as ``CC-CODE-VERSION``, the waiver as ``CC0``, others
    by their first 24 characters."""
    c = _c(rights)
    path = r"licen[cs]es[^/]*/(?:[^/]*/)?([a-z]{2}(?:-[a-z]{2})*)/(\d[\d.]*)"
    code, version = (F.regexp_extract(c, path, k) for k in (1, 2))
    return F.when(F.contains(c, F.lit("publicdomain/zero")), F.lit("CC0")).when(code != "", F.concat(F.lit("CC-"), F.upper(code), F.lit("-"), version)).otherwise(F.substring(c, 1, 24))


def paragraphs(text: Column | str) -> Column:
    """Blocks between blank lines, their lines joined by spaces."""
    plain = F.regexp_replace(_c(text), r"\r\n?", "\n")
    blocks = F.transform(F.split(plain, r"\n[ \t]*(?:\n[ \t]*)+"), lambda b: F.trim(F.regexp_replace(b, r"\s*\n\s*", " ")))
    return F.filter(blocks, lambda b: b != "")


def visible_length(text: Column | str) -> Column:
    """Length without colour codes and match marks."""
    return F.length(F.regexp_replace(_c(text), r"\x1B\[[0-9;]*m|[\x01\x02]", ""))


def wrap_count(text: Column | str, width: int) -> Column:
    """Lines that greedy wrapping takes; a longer word has a line of its own."""
    words = F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("used"))

    def step(state: Column, word: Column) -> Column:
        fits = (state["used"] > 0) & (state["used"] + 1 + F.length(word) <= width)
        return F.struct(F.when(fits, state["lines"]).otherwise(state["lines"] + 1).alias("lines"), F.when(fits, state["used"] + 1 + F.length(word)).otherwise(F.length(word)).alias("used"))

    return F.aggregate(words, start, step, lambda s: s["lines"])


def wrap_text(text: str, width: int) -> list[str]:
    """The lines themselves, for one string."""
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return lines


def slug(title: Column | str, words: int = 6, size: int = 60) -> Column:
    """Up to six cleaned lower-case words, none after the length is exceeded."""
    clean = F.filter(F.split(norm_title(title), " "), lambda w: w != "")
    start = F.lit("")
    grow = lambda s, w: F.when(F.length(s) > size, s).otherwise(F.concat_ws("-", F.when(s != "", s), w))
    return F.aggregate(F.slice(clean, 1, words), start, grow)


def file_name(paper_id: Column | str, title: Column | str) -> Column:
    """``YYYY-NNNN-slug.pdf``."""
    parts = split_id(paper_id)
    name = F.concat(F.format_string("%04d-%04d", parts["year"], parts["number"]), F.when(slug(title) != "", F.concat(F.lit("-"), slug(title))).otherwise(F.lit("")), F.lit(".pdf"))
    return F.when(parts.isNotNull(), name)


def slug_words(name: Column | str) -> Column:
    """The title part of a file name, dashes as spaces."""
    part = F.regexp_extract(_c(name), r"^[^-]*-[^-]*-(.*?)(?:\.pdf)?$", 1)
    return F.replace(part, F.lit("-"), F.lit(" "))


def names_paper(name: Column | str, year: int, number: int) -> Column:
    """Whether a file name holds the paper's number, and no other year than its own."""
    groups = F.transform(F.regexp_extract_all(_c(name), F.lit(r"(\d+)"), F.lit(1)), lambda g: g.try_cast("bigint"))
    return F.exists(groups, lambda g: g == number) & ~claims_other_year(name, year)


def claims_other_year(name: Column | str, year: int) -> Column:
    """Whether a file name has a group of four digits that reads as another year."""
    groups = F.regexp_extract_all(_c(name), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))
    return (F.size(groups) > 0) & ~F.array_contains(groups, f"{year:04d}")


def megabytes(size: Column | str) -> Column:
    return F.concat(F.call_function("format_number", _c(size) / F.lit(1e6), F.lit("0.0")), F.lit(" MB"))


def citation_key(key: Column | str, paper_id: Column | str, prefix: str = "preprint") -> Column:
    """The known key, else one made of the id."""
    return F.coalesce(_c(key), F.concat(F.lit(f"{prefix}:"), _c(paper_id)))
