"""Queries over this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, characters, leakage, linkage, lookalike, split, variants
from lectern.operators import multivalue
from lectern.plans.tables import table
from lectern.session import written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link_works(table(spark, d, "papers"), table(spark, d, "bib_entries")).select("paper_id", "bib_key")


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """The matches with their confidence."""
    return linkage.link_works(table(spark, d, "papers"), table(spark, d, "bib_entries"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.same_name_pairs(table(spark, d, "author_names"), table(spark, d, "aliases"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per spelling with the group it belongs to."""
    return variants.name_groups(table(spark, d, "author_names"), table(spark, d, "aliases"))


def p3_bylines(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct spelling in bylines or author_names with its group."""
    listed = table(spark, d, "author_names").select("name")
    typed = multivalue.split_values(table(spark, d, "papers"), "id", "authors", "rec_key").select("name")
    names = typed.union(listed).filter(F.col("name").isNotNull()).distinct().withColumn("name_id", F.monotonically_increasing_id())
    names = written(names, "spellings")
    return variants.name_groups(names, table(spark, d, "aliases")).join(names, "name_id").select("name", "group")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unusual_fields(table(spark, d, "papers"), "id", ("title", "authors"))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every title and byline in its one form."""
    return lookalike.canonical_values(lookalike.field_values(table(spark, d, "papers"), "id", ("title", "authors"))).select("id", "field", "canonical")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter(F.col("equal_words") >= leakage.WORDS).select("item_id", "doc_id")


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Also the overlaps with substitutions."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that :func:`split.split_documents` cuts; each has a first piece."""
    pieces = split.split_documents(table(spark, d, "documents"), oversized_only=True)
    return pieces.filter(F.col("piece") == 1).select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_documents(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p3_found, p3_groups, p3_bylines, p4_found, p4_canonical, p6_ids, p7_found, p7_overlaps, p8_found, p8_pieces)}


def _pair(table: dict[str, str]) -> str:
    return f"'{''.join(table)}', '{''.join(table.values())}'"


def _class(codes) -> str:
    return "".join(f"\\x{{{c:X}}}" for c in codes)


def _look_alike_sql() -> str:
    """The look-alike mapping in DuckDB SQL; without the exceptions for joiners, which no
    title or byline of the test tables needs."""
    c, look = characters, lookalike
    wide = {a: b for a, b in look.WIDE.items() if b != "'"}
    seen = f"regexp_replace(v, '[{_class(c.INVISIBLE)}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x84\\x86-\\x9F]', '', 'g')"
    plain = f"translate({seen}, {_pair({chr(x): ' ' for x in c.ODD_SPACES} | {chr(x): '-' for x in c.ODD_HYPHENS} | wide)})"
    for ligature, letters in look.LIGATURES.items():
        plain = f"replace({plain}, '{ligature}', '{letters}')"
    scripts = "[\\p{Cyrillic}\\p{Greek}\\p{Armenian}]"
    other = lambda x: f"regexp_matches(translate({x}, '{''.join(look.FOREIGN)}', ''), '{scripts}')"
    latin = lambda x: f"regexp_matches({x}, '\\p{{Latin}}')"
    alike = f"regexp_matches(w, '[{''.join(look.FOREIGN)}]')"
    word = f"""CASE WHEN {latin('w')} AND {alike} AND NOT {other('w')} THEN translate(w, {_pair(c.ALIKE)})
      WHEN {latin('w')} AND regexp_matches(w, '\\p{{Cyrillic}}') AND {other('w')} AND NOT {latin(f"translate(w, '{''.join(look.TO_CYRILLIC)}', '')")} THEN translate(w, {_pair(look.TO_CYRILLIC)})
      WHEN {alike} AND NOT {latin('w')} AND NOT {other('w')} AND {latin('plain')} AND NOT {other('plain')} THEN translate(w, {_pair(c.ALIKE)})
      WHEN regexp_matches(w, '[{''.join(c.LATIN_ALIKE)}]') AND regexp_matches(w, '[a-z]') THEN translate(w, {_pair(c.LATIN_ALIKE)}) ELSE w END"""
    return f"""
WITH fields AS (SELECT id, 'title' AS field, title AS v FROM papers UNION ALL SELECT id, 'authors', authors FROM papers),
mapped AS (SELECT id, field, v, {plain} AS plain FROM fields),
forms AS (SELECT id, field, v, nfc_normalize(array_to_string(list_transform(regexp_extract_all(plain, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {word}), '')) AS canonical FROM mapped)
"""


SQL: dict[str, str] = {
    "p4_found": _look_alike_sql() + "SELECT DISTINCT id, field FROM forms WHERE v <> canonical",
    "p4_canonical": _look_alike_sql() + "SELECT id, field, canonical FROM forms",
}
