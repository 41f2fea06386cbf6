"""An inverted index as a table, for selective searches over very large collections.

One row per stem and paper, sorted by stem within buckets.  A query first reads the
buckets of the terms it cannot do without and gets a superset of its ids; the exact
predicate over the analysed columns then runs on those papers only.  A query that needs
no particular term, or only short prefixes, is left to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import fts
from lectern.operators.query import Query, matching

#: Buckets of an index of some terabytes; small ones need few.
BUCKETS = 256
#: A frequent stem is spread over so many files of its bucket.
SALTS = 8
#: Shorter prefixes select too much to be worth a lookup.
PREFIX = 4


def bucket_of(stem: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(buckets)).cast("int")


def build(papers: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of analysed papers (see ``query.searchable``).

    A stem counts once per paper whatever its columns and repetitions; null columns have
    no stems.  Rows are spread by bucket and a salt of the id, so a stem that most papers
    have does not end up in one task."""
    columns = list(fts.COLUMNS.values())
    stems = F.array_distinct(F.flatten(F.array(*[F.split(F.trim(F.coalesce(c, F.lit(""))), " ") for c in columns])))
    rows = papers.select("id", F.explode(stems).alias("stem")).filter(F.col("stem") != "").withColumn("bucket", bucket_of(F.col("stem"), buckets))
    spread = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    spread.sortWithinPartitions("bucket", "stem").write.partitionBy("bucket").mode("overwrite").parquet(path)


def _term(index: DataFrame, stem: str, buckets: int) -> DataFrame:
    return index.filter((F.col("bucket") == bucket_of(F.lit(stem), buckets)) & (F.col("stem") == stem)).select("id")  # a constant, so other buckets are not read


def _prefix(index: DataFrame, stem: str) -> DataFrame:
    return index.filter(F.startswith("stem", F.lit(stem))).select("id").distinct()


def _all(parts: list[DataFrame | None]) -> DataFrame | None:
    """The ids in all parts; a part that selects nothing in particular does not narrow."""
    known = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), known) if known else None


def candidates(index: DataFrame, node: fts.Node, analysis: fts.Analysis | None = None, buckets: int = BUCKETS) -> DataFrame | None:
    """Ids of all papers that can match, and maybe more; None if the query needs no
    particular term."""
    analysis = analysis or fts.Analysis()
    if isinstance(node, fts.Phrase):
        options = []
        for terms in {tuple(v) for column in ("title", "authors") for v in analysis.variants(node, column)}:
            whole = list(terms[:-1] if node.prefix else terms)
            parts = [_term(index, t, buckets) for t in whole]
            if node.prefix and not whole and len(terms[-1]) >= PREFIX:
                parts.append(_prefix(index, terms[-1]))
            options.append(_all(parts))
        if not options or any(o is None for o in options):
            return None
        return reduce(lambda a, b: a.union(b), options).distinct()
    if isinstance(node, fts.Near):
        return _all([candidates(index, p, analysis, buckets) for p in node.phrases])
    if isinstance(node, fts.Within):
        return candidates(index, node.inner, analysis, buckets)
    if isinstance(node, fts.Without):
        return candidates(index, node.left, analysis, buckets)
    left, right = candidates(index, node.left, analysis, buckets), candidates(index, node.right, analysis, buckets)
    if isinstance(node, fts.Both):
        return _all([left, right])
    return left.union(right).distinct() if left is not None and right is not None else None


def indexed(papers: DataFrame, index: DataFrame, query: Query, watch_hits: DataFrame | None = None, stemmed: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """What ``query.matching`` returns, reading only the papers that the index names."""
    node = fts.read(query.terms, query.prefix, query.compat)
    ids = candidates(index, node, fts.Analysis(stemmed), buckets) if node is not None else None
    return matching(papers if ids is None else papers.join(ids, "id", "left_semi"), query, watch_hits, stemmed)
