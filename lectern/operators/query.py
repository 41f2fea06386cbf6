"""Searching the paper table: text, filters, order, counts.

A :class:`Query` compiles to one predicate; page and count share it.  Nothing runs until
the caller acts on the returned DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.names import author_match, fold_name
from lectern.functions.text import analyse, mark_phrases
from lectern.operators import fts

#: Columns of a paper in their fixed order.
PAPER = ("id", "title", "authors", "abstract", "category", "date", "year", "rights", "url")
SEARCH_LIMIT = 20


@dataclass(frozen=True)
class Query:
    """What to look for; every part is optional.  ``since`` is inclusive, ``before``
    exclusive, both ISO days; ``added_after`` is exclusive; no limit means all."""

    terms: str = ""
    year: int | None = None
    since: str | None = None
    before: str | None = None
    added_after: str | None = None
    only_watched: bool = False
    author: str | None = None
    category: str | None = None
    scope: str = "all"
    prefix: bool = True
    limit: int | None = None
    compat: bool = False


def searchable(papers: DataFrame, stemmed: bool = True) -> DataFrame:
    """Papers with the analysed columns that text search needs; write it once, and search
    what was written.  The byline is indexed folded, the other columns as they are."""
    folded = papers.withColumn("authors_norm", fold_name("authors"))
    targets = {"title": "title_norm", "authors_norm": "authors_norm", "abstract": "abstract_norm", "category": "category_norm"}
    return analyse(folded, targets, stemmed)


def filters(query: Query) -> list[Column]:
    """The structured conditions, in the order in which they narrow best."""
    out = []
    if query.year is not None:
        out.append(F.col("year") == query.year)
    if query.since is not None:
        out.append(F.col("date") >= query.since)
    if query.before is not None:
        out.append(F.col("date") < query.before)
    if query.added_after is not None:
        out.append(F.col("added") > F.lit(query.added_after).cast("timestamp_ntz"))
    if query.category:
        out.append(F.contains(F.lower(F.col("category")), F.lit(query.category.lower())))
    if query.author:
        out.append(author_match("authors", query.author))
    return out


def matching(papers: DataFrame, query: Query, watch_hits: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """The papers that a query selects, in no order.  Text conditions need the analysed
    columns of :func:`searchable`; a query without terms does not."""
    out = papers
    for condition in filters(query):
        out = out.filter(condition)
    node = fts.read(query.terms, query.prefix, query.compat)
    if node is not None:
        out = out.filter(fts.predicate(node, query.scope, fts.Analysis(stemmed)))
    if query.only_watched:
        if watch_hits is None:
            raise ValueError("only_watched needs the hits of standing queries")
        out = out.join(watch_hits.select("id").distinct(), "id", "left_semi")
    return out


def search(papers: DataFrame, query: Query, watch_hits: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """Newest first, ties by id; at most ``limit`` rows."""
    out = matching(papers, query, watch_hits, stemmed).select(*PAPER).orderBy(F.desc("date"), F.desc("id"))
    return out if query.limit is None else out.limit(query.limit)


def count(papers: DataFrame, query: Query, watch_hits: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """One row ``n``: how many papers a query selects, whatever its limit."""
    return matching(papers, replace(query, limit=None), watch_hits, stemmed).agg(F.count("*").alias("n"))


def highlighted(hits: DataFrame, query: Query, stemmed: bool = True) -> DataFrame:
    """``hits`` with ``title_hl`` and ``abstract_hl``: matches marked, in the columns the
    query may match only.  Meant for a page of results; one narrow Arrow pass."""
    node = fts.read(query.terms, query.prefix, query.compat)
    if node is None:
        return hits.withColumns({"title_hl": F.col("title"), "abstract_hl": F.col("abstract")})
    analysis = fts.Analysis(stemmed)
    marked = {}
    for column in ("title", "abstract"):
        wanted = [(terms, p.prefix) for p, names in fts.phrases(node, fts.SCOPES[query.scope]) if column in names for terms in [analysis.terms(p.text)] if terms]
        mark = mark_phrases(wanted, stemmed)
        marked[f"{column}_hl"] = F.pandas_udf(lambda s, mark=mark: s.map(mark), T.StringType())(F.col(column))
    return hits.withColumns(marked)


# -- lookups ---------------------------------------------------------------------------


def get(papers: DataFrame, paper_id: str) -> DataFrame:
    return papers.filter(F.col("id") == paper_id).select(*PAPER)


def titles(papers: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(id, title) of the given ids; none for no ids."""
    return papers.filter(F.col("id").isin(list(ids)) if ids else F.lit(False)).select("id", "title")


def titled(files: DataFrame, papers: DataFrame) -> DataFrame:
    """Files (id, name_title) with the paper's title, or the one their name gives."""
    return files.join(papers.select("id", "title"), "id", "left").select("id", F.coalesce("title", "name_title").alias("title"))


# -- figures ---------------------------------------------------------------------------


def categories(papers: DataFrame) -> DataFrame:
    """(category, n), most frequent first; papers without a category do not count."""
    return papers.filter(F.col("category") != "").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def newest(papers: DataFrame) -> DataFrame:
    """One row (id, date) of the latest paper; ties by id."""
    best = F.max_by(F.struct("id", "date"), F.struct("date", "id"))
    return papers.agg(best.alias("x")).select("x.id", "x.date")


def status(papers: DataFrame, links: DataFrame, state: dict[str, str] | None = None) -> DataFrame:
    """One row: papers, the newest date, links by kind, when the feed was last read."""
    figures = papers.agg(F.count("*").alias("papers"), F.max("date").alias("newest"))
    linked = links.agg(F.count("*").alias("links"), F.count_if(F.col("kind") == "published").alias("published"), F.count_distinct("paper_id").alias("linked"))
    return figures.crossJoin(F.broadcast(linked)).withColumn("last_harvest", F.lit((state or {}).get("last_harvest")))
