"""Published versions of preprints by exact title, shared surname and nearest year, and
the lookups over the resulting links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.biblio import norm_title, paper_id_in, surnames
from lectern.functions.names import byline_names

PREPRINT, PUBLISHED = "preprint", "published"
#: Years apart where either year is unknown.
UNKNOWN_GAP = 99


def byline_surnames(byline: Column | str) -> Column:
    """Normalised surnames of a ``;``-separated byline."""
    return surnames(F.array_join(byline_names(byline), " and "))


def _year(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("int"), F.lit(0))


def year_gap(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), F.lit(UNKNOWN_GAP)).otherwise(F.abs(a - b))


def link_published(papers: DataFrame, entries: DataFrame, compat: bool = False) -> DataFrame:
    """(paper_id, key, kind, year, entry): for each paper the published entry of the same
    normalised title with a surname in common and the nearest year, the smallest key of
    equally near ones.

    Entries whose title has no letters or digits match nothing.  ``compat`` reads a year
    only where it is written in braces or quotes in the entry's source.  Both sides are
    reduced to one row per title and surname before they meet, so a title that many
    records share is spread by surname; the best entry of a paper is a hash aggregate.
    """
    years = F.when(F.col("raw").rlike(r'(?is)\byear\s*=\s*[{"]'), _year(F.col("year"))).otherwise(F.lit(0)) if compat else _year(F.col("year"))
    left = papers.select(F.col("id").alias("paper_id"), norm_title("title").alias("t"), _year(F.col("year")).alias("y"), F.explode(F.array_distinct(byline_surnames("authors"))).alias("s")).filter("t <> ''")
    right = entries.filter(F.col("key").isNotNull()).select("key", norm_title("title").alias("t"), years.alias("by"), F.col("year").alias("year"), F.col("raw").alias("entry"), F.explode(F.array_distinct(surnames("author"))).alias("s")).filter("t <> ''")
    # of the entries alike in title, surname and year only the smallest key can win
    right = right.groupBy("t", "s", "by").agg(F.min_by(F.struct("key", "year", "entry"), F.struct("key", "year", "entry")).alias("x"))
    met = left.join(right, ["t", "s"]).select("paper_id", F.struct(year_gap(F.col("y"), F.col("by")).alias("gap"), F.col("x.key").alias("key")).alias("rank"), "x")
    best = met.groupBy("paper_id").agg(F.min_by("x", "rank").alias("x"))
    return best.select("paper_id", "x.key", F.lit(PUBLISHED).alias("kind"), "x.year", "x.entry")


def link_preprints(papers: DataFrame, entries: DataFrame) -> DataFrame:
    """The archive's own entries, by the id they name; of several the last key wins."""
    named = entries.filter(F.col("key").isNotNull()).select("key", paper_id_in("howpublished").alias("paper_id"), "year", F.col("raw").alias("entry")).filter(F.col("paper_id").isNotNull())
    last = named.groupBy("paper_id").agg(F.max_by(F.struct("key", "year", "entry"), F.struct("key", "year", "entry")).alias("x"))
    known = last.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    return known.select("paper_id", "x.key", F.lit(PREPRINT).alias("kind"), "x.year", "x.entry")


def upsert_links(links: DataFrame, order: str) -> DataFrame:
    """One row per (paper_id, kind): the last by ``order``."""
    rest = [c for c in links.columns if c not in ("paper_id", "kind")]
    return links.groupBy("paper_id", "kind").agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("x")).select("paper_id", "kind", "x.*")


def best_links(links: DataFrame) -> DataFrame:
    """(paper_id, key, is_published, entry): the published link if there is one, else
    the archive's own."""
    published = F.col("kind") == PUBLISHED
    best = F.max_by(F.struct("key", published.alias("is_published"), "entry"), F.struct(published, "key"))
    return links.groupBy("paper_id").agg(best.alias("x")).select("paper_id", "x.*")


def with_links(papers: DataFrame, links: DataFrame) -> DataFrame:
    """Papers with ``key`` and ``is_published`` of their best link, null without one."""
    found = best_links(links).select(F.col("paper_id").alias("id"), "key", "is_published")
    return papers.join(found, "id", "left")


def coverage(papers: DataFrame, links: DataFrame) -> DataFrame:
    """One row: papers, linked ones, published ones, and their share in percent."""
    n = papers.agg(F.count("*").alias("papers"))
    linked = links.agg(F.count_distinct("paper_id").alias("linked"), F.count_distinct(F.when(F.col("kind") == PUBLISHED, F.col("paper_id"))).alias("published"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, 100 * F.col(a) / F.col(b)), 1)
    return n.crossJoin(F.broadcast(linked)).select("papers", "linked", "published", share("linked", "papers").alias("linked_percent"), share("published", "linked").alias("published_percent"))
