"""Standing queries: their text form, and the table of what they match.

A standing query is a line such as ``lattice "key exchange" --author "A. Name"
--category protocols --title``.  Its label is its identity.  The hits of all queries come
from one scan of the papers: each query is one predicate, and a row carries the labels of
the predicates that hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.names import person_form_text
from lectern.operators import fts
from lectern.operators.query import Query, filters

_FLAGS = {"--author": "author", "-a": "author", "--category": "category", "-c": "category"}
_HITS = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType())])


@dataclass(frozen=True)
class Watch:
    terms: str = ""
    author: str | None = None
    category: str | None = None
    scope: str = "all"

    @classmethod
    def make(cls, terms: str = "", author: str | None = None, category: str | None = None, scope: str = "all") -> Watch:
        """A watch from what a user gave: blanks count as absent, the author stands in
        natural order; nothing at all is an error."""
        terms, author, category = terms.strip(), (author or "").strip() or None, (category or "").strip() or None
        if not (terms or author or category):
            raise ValueError("there is nothing to watch")
        return cls(terms, person_form_text(author) if author else None, category, scope)

    def label(self) -> str:
        """The line that :func:`parse_watch` reads back."""
        parts = [self.terms] if self.terms else []
        for flag, value in (("--author", self.author), ("--category", self.category)):
            if value:
                parts += [flag, f'"{value}"' if any(c.isspace() for c in value) else value]
        if self.scope == "title":
            parts.append("--title")
        return " ".join(parts)

    def describe(self) -> str:
        """For display only."""
        out = self.terms or "everything"
        if self.author:
            out += f" by {self.author}"
        if self.category:
            out += f" in {self.category}"
        return out + (" (titles and bylines)" if self.scope == "title" else "")

    def query(self) -> Query:
        """No dates; prefixes on."""
        return Query(terms=self.terms, author=self.author, category=self.category, scope=self.scope)


def parse_watch(line: str) -> Watch | None:
    """The watch of a line; None if it has nothing to watch.  A line quoted as a whole is
    unwrapped if it holds a flag."""
    line = line.strip()
    if len(line) > 1 and line[0] == line[-1] == '"' and '"' not in line[1:-1] and any(f in line.split() or f in line[1:-1].split() for f in (*_FLAGS, "--title", "-t")):
        line = line[1:-1]
    tokens = fts.split_tokens(line)
    found: dict[str, str] = {}
    terms, scope, k = [], "all", 0
    while k < len(tokens):
        token = tokens[k]
        if token in _FLAGS and k + 1 < len(tokens):
            found[_FLAGS[token]] = tokens[k + 1].strip('"')
            k += 1
        elif token in ("--title", "-t"):
            scope = "title"
        elif token not in _FLAGS:
            terms.append(token)
        k += 1
    try:
        return Watch.make(" ".join(terms), found.get("author"), found.get("category"), scope)
    except ValueError:
        return None


def round_trips(watch: Watch) -> bool:
    """Whether the label stands for exactly this watch."""
    return parse_watch(watch.label()) == watch


def add(watches: Sequence[Watch], watch: Watch) -> list[Watch]:
    """With the watch at the end; one with the same label is left as it is."""
    if not round_trips(watch):
        raise ValueError("the watch has no faithful text form")
    return list(watches) if any(w.label() == watch.label() for w in watches) else [*watches, watch]


def remove(watches: Sequence[Watch], number: int | None = None) -> list[Watch]:
    """Without the watch of that number, from 1, or without any."""
    if number is None:
        return []
    if not 1 <= number <= len(watches):
        raise ValueError(f"there is no watch {number}")
    return [w for k, w in enumerate(watches, 1) if k != number]


# -- matching --------------------------------------------------------------------------


def _condition(watch: Watch, stemmed: bool):
    out = F.lit(True)
    query = watch.query()
    for condition in filters(query):
        out = out & condition
    try:
        node = fts.read(query.terms, query.prefix)
    except fts.QueryError:
        return None
    return out & fts.predicate(node, query.scope, fts.Analysis(stemmed)) if node is not None else out


def match_all(papers: DataFrame, watches: Sequence[Watch], stemmed: bool = True) -> DataFrame:
    """(id, label) of every paper and every watch it meets, in one scan.  A watch that
    cannot be read contributes nothing."""
    labelled = [(w.label(), _condition(w, stemmed)) for w in dict.fromkeys(watches)]
    tests = [F.when(c, F.lit(label)) for label, c in labelled if c is not None]
    if not tests:
        return papers.sparkSession.createDataFrame([], _HITS)
    return papers.select("id", F.explode(F.array_compact(F.array(*tests))).alias("label")).distinct()


def sync(hits: DataFrame, papers: DataFrame, watches: Sequence[Watch], known: Sequence[str], changed: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """The hits brought up to date: those of watches that are gone leave, new watches are
    matched with all papers, the others with ``changed`` papers only (id and the search
    columns; deleted ones need their id alone in ``hits`` to be matched away)."""
    wanted = [w.label() for w in watches]
    kept = hits.filter(F.col("label").isin([x for x in wanted if x in known]))
    fresh = match_all(papers, [w for w in watches if w.label() not in known], stemmed)
    if changed is None:
        return kept.unionByName(fresh).distinct()
    kept = kept.join(changed.select("id").distinct(), "id", "left_anti")
    again = match_all(changed, [w for w in watches if w.label() in known], stemmed)
    return kept.unionByName(fresh).unionByName(again).distinct()


def counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("label").agg(F.count("*").alias("n"))


def watched(hits: DataFrame) -> DataFrame:
    return hits.select("id").distinct()


def listing(hits: DataFrame, watches: Sequence[Watch]) -> DataFrame:
    """(number, label, description, n) of every watch, in order."""
    spark = hits.sparkSession
    rows = [(k, w.label(), w.describe()) for k, w in enumerate(watches, 1)]
    table = spark.createDataFrame(rows, "number int, label string, description string")
    return table.join(counts(hits), "label", "left").select("number", "label", "description", F.coalesce("n", F.lit(0)).alias("n"))


__all__ = ["Watch", "add", "counts", "listing", "match_all", "parse_watch", "remove", "round_trips", "sync", "watched"]
