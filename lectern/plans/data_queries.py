"""Queries over the change feed and over packed fields."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import cdc, multivalue
from lectern.plans import sql
from lectern.plans.tables import table
from lectern.session import own_folder


def _published(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a published table, read back."""
    folder = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    cdc.publish(df, folder)
    return cdc.current(df.sparkSession, folder)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _published(cdc.last_changes(table(spark, d, "cdc_records"), table(spark, d, "papers")), "changes").select("id", "seq")


def p2_state(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt table, all its columns."""
    return _published(cdc.apply_feed(table(spark, d, "papers"), table(spark, d, "cdc_records")), "papers")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    papers = multivalue.split_values(table(spark, d, "papers"), "id", "authors", "rec_key")
    entries = multivalue.split_values(table(spark, d, "bib_entries"), "key", "author", "rec_key")
    return papers.select(F.lit("papers").alias("source"), "*").unionByName(entries.select(F.lit("bib_entries").alias("source"), "*"))


QUERIES = {f.__name__: f for f in (p2_found, p2_state, p5_found)}

_CHANGES = """
WITH records AS (
  SELECT nullif(trim(list_last(string_split(id, ':')), E' \\t\\n\\r'), '') AS id, op, changed_at, min(seq) AS seq, arg_min(received_at, seq) AS received_at
  FROM cdc_records WHERE op IN ('live', 'deleted')
  GROUP BY 1, op, changed_at, title, rights, creators, descriptions, subjects, dates, identifiers
), effective AS (
  SELECT r.id, r.op, r.changed_at, r.seq, r.received_at FROM records r LEFT JOIN papers p ON p.id = r.id
  WHERE r.id IS NOT NULL AND (p.id IS NULL OR p.date = '' OR r.changed_at > CAST(replace(p.date, 'Z', '') AS TIMESTAMP))
), last AS (
  SELECT id, arg_max(op, (changed_at, seq)) AS op, arg_max(seq, (changed_at, seq)) AS seq FROM effective GROUP BY id
)
"""
SQL = {
    "p2_found": _CHANGES + "SELECT id, seq FROM last",
    "p2_state": _CHANGES
    + f"""
, dead AS (
  SELECT id, max((changed_at, seq)) AS x FROM effective WHERE op = 'deleted' GROUP BY id
), arrived AS (
  SELECT e.id, arg_min(e.received_at, (e.changed_at, e.seq)) AS added FROM effective e LEFT JOIN dead d ON d.id = e.id
  WHERE e.op = 'live' AND (d.x IS NULL OR (e.changed_at, e.seq) > d.x) GROUP BY e.id
), content AS (
  SELECT DISTINCT l.id, coalesce(trim(r.title), '') AS title, coalesce(array_to_string(list_filter(r.creators, lambda x: trim(x) <> ''), '; '), '') AS authors,
    coalesce((SELECT arg_max(x, (strlen(x), -i)) FROM (SELECT unnest(r.descriptions) AS x, generate_subscripts(r.descriptions, 1) AS i)), '') AS abstract,
    coalesce(r.subjects[1], '') AS category, coalesce(r.rights, '') AS rights,
    coalesce(list_filter(r.identifiers, lambda x: starts_with(x, 'http'))[1], '') AS url, coalesce(r.dates[1], '') AS date,
    coalesce(TRY_CAST(nullif(regexp_extract(coalesce(r.dates[1], ''), '^(\\d{{4}})', 1), '') AS INTEGER), TRY_CAST(regexp_extract(l.id, '^(\\d{{4}})', 1) AS INTEGER), 0) AS year
  FROM last l JOIN cdc_records r ON r.seq = l.seq AND nullif(trim(list_last(string_split(r.id, ':')), E' \\t\\n\\r'), '') = l.id
  WHERE l.op = 'live'
)
SELECT id, title, authors, authors_fold, abstract, category, rights, url, date, year, added FROM papers WHERE id NOT IN (SELECT id FROM last)
UNION ALL
SELECT c.id, c.title, c.authors, {sql.fold('c.authors')}, c.abstract, c.category, c.rights, c.url, c.date, c.year,
  CASE WHEN p.id IS NOT NULL AND d.id IS NULL THEN p.added ELSE a.added END
FROM content c LEFT JOIN papers p ON p.id = c.id LEFT JOIN dead d ON d.id = c.id LEFT JOIN arrived a ON a.id = c.id
""",
}
