"""Suggesting authors and categories for what a user has begun to type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.names import author_match, byline_names, deaccent, fold_name, fold_text, split_surname

SUGGESTIONS = 40


def suggest_authors(papers: DataFrame, needle: str, limit: int = SUGGESTIONS) -> DataFrame:
    """(value, papers): names that match ``needle``, each as "Surname, Rest" and in full.

    Spellings that differ in accents only are one; an accented one is shown.  A name
    counts the papers it is on.  The ``limit`` most frequent names are turned into both
    forms, those that contain the needle stay, ones that start with it first, then by
    papers, then by value.  Needles of fewer than two characters match nothing.
    """
    folded = fold_text(needle)
    names = papers.select(F.col("id"), F.explode(F.array_distinct(byline_names("authors"))).alias("name"))
    wanted = names.filter(author_match("name", needle) if len(folded) >= 2 else F.lit(False))
    plain = wanted.withColumn("plain", deaccent("name"))
    counted = plain.groupBy("plain").agg(F.count_distinct("id").alias("papers"), F.min_by("name", F.struct((F.col("name") == F.col("plain")), F.col("name"))).alias("name"))
    top = counted.orderBy(F.desc("papers"), "plain").limit(limit)
    parts = split_surname("name")
    turned = F.when(parts.isNotNull(), F.concat(parts["surname"], F.lit(", "), parts["rest"]))
    forms = top.select("papers", F.explode(F.array_distinct(F.array_compact(F.array(turned, F.col("name"))))).alias("value")).withColumn("_fold", fold_name("value"))
    kept = forms.filter(F.contains("_fold", F.lit(folded)))
    return kept.orderBy(~F.startswith("_fold", F.lit(folded)), F.desc("papers"), "value").limit(limit).select("value", "papers")


def suggest_categories(papers: DataFrame, needle: str, limit: int = SUGGESTIONS) -> DataFrame:
    """(category, n) of the categories that contain the needle in any case."""
    found = papers.filter((F.col("category") != "") & F.contains(F.lower(F.col("category")), F.lit(needle.lower())))
    return found.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(limit)
