"""Queries over the paper table: text search, filters, counts, names, links, feed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import biblio, dates, names
from lectern.functions.text import mark_words
from lectern.operators import byline, feed, link, postings, query, suggest, watch
from lectern.operators.query import Query
from lectern.plans import sql
from lectern.plans.tables import table
from lectern.session import own_folder
from lectern.sources import bibtex, oai
from lectern.sources.files import json_rows
from lectern.streaming.feed_stream import first_seen, merge_state

NOW = datetime(2025, 2, 1)
Maker = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Maker] = {}
SQL: dict[str, str] = {}


def _add(name: str, make: Maker, text: str | None = None) -> None:
    QUERIES[name] = make
    if text is not None:
        SQL[name] = text


def _papers(make: Callable[[DataFrame], DataFrame]) -> Maker:
    return lambda spark, d: make(table(spark, d, "papers"))


# -- text search -----------------------------------------------------------------------


def _text(name: str, terms: str, where: str, **options) -> None:
    """An unstemmed search as a query, with its SQL condition over analysed columns."""
    wanted = Query(terms=terms, prefix=options.pop("prefix", False), **options)
    _add(name, _papers(lambda p, q=wanted: query.matching(query.searchable(p, stemmed=False), q, stemmed=False).select("id", "title")), f"SELECT id, title FROM {sql.ANALYSED} WHERE {where}")


_any = sql.anywhere
_text("fts_term", "encryption", _any(" encryption "))
_text("fts_and", "hash functions", f"{_any(' hash ')} AND {_any(' functions ')}")
_text("fts_or", "signatures OR beacons", f"{_any(' signatures ')} OR {_any(' beacons ')}")
_text("fts_not", "encryption NOT lattice AND proofs", f"({_any(' encryption ')} AND NOT {_any(' lattice ')}) AND {_any(' proofs ')}")
_text("fts_not_row", "encryption NOT proofs commitments", f"{_any(' encryption ')} AND NOT ({_any(' proofs ')} AND {_any(' commitments ')})")
_text("fts_group", "(hash OR ring) AND signatures", f"({_any(' hash ')} OR {_any(' ring ')}) AND {_any(' signatures ')}")
_text("fts_prefix", "homomorph", _any(" homomorph"), prefix=True)
_text("fts_phrase", '"zero knowledge proofs"', _any(" zero knowledge proofs "))
_text("fts_phrase_prefix", '"group sig"', _any(" group sig"), prefix=True)
_text("fts_concat", "hash + functions", _any(" hash functions "))
_text("fts_initial", "^how to", f"(starts_with(t, ' how ') OR starts_with(a, ' how ') OR starts_with(b, ' how ') OR starts_with(c, ' how ')) AND {_any(' to ')}")
_text("fts_near", "NEAR(lattice encryption, 4)", " OR ".join(f"regexp_matches({c}, ' (lattice (\\S+ ){{0,4}}encryption|encryption (\\S+ ){{0,4}}lattice) ')" for c in "tabc"))
_text("fts_column", "title : (random beacons)", "contains(t, ' random ') AND contains(t, ' beacons ')")
_text("fts_columns", "{title category} : protocols", "contains(t, ' protocols ') OR contains(c, ' protocols ')")
_text("fts_not_column", "- title : lattice", "contains(a, ' lattice ') OR contains(b, ' lattice ') OR contains(c, ' lattice ')")
_text("fts_scope_title", "secret sharing", "(contains(t, ' secret') OR contains(a, ' secret')) AND (contains(t, ' sharing') OR contains(a, ' sharing'))", prefix=True, scope="title")
_text("fts_author_term", "authors : chloé", f"contains(a, ' chloe ') OR contains(a, ' {names.fold_text('chloé')} ')")
_text("fts_hyphen", "zero-knowledge", _any(" zero knowledge"), prefix=True)
_text("fts_lower_or", "code or sessions", f"{_any(' code')} AND {_any(' or ')} AND {_any(' sessions')}", prefix=True)
_text("fts_retry", "encryption OR signatures?", f"{_any(' encryption')} OR {_any(' signatures')}", prefix=True)
_text("fts_filtered", "encryption", f"{_any(' encryption ')} AND year = 2020 AND date >= '2020-03-01' AND contains(lower(category), 'crypto')", year=2020, since="2020-03-01", category="CRYPTO")


def _stemmed(p: DataFrame, wanted: Query) -> DataFrame:
    return query.search(query.searchable(p), wanted)


#: The words of the collection's language that a stem stands for.
_WORDS = {"commit": "commit|commits|committed|committing|commitment|commitments", "signatur": "signature|signatures", "group": "group|groups|grouped|grouping", "hash": "hash|hashes|hashed|hashing"}
_one_of = lambda stem: "(" + " OR ".join(f"regexp_matches({c}, ' ({_WORDS[stem]}) ')" for c in "tabc") + ")"
_row = "id, title, authors, abstract, category, date, year, rights, url"
_groups = " OR ".join(f"regexp_matches({c}, ' ({_WORDS['group']}) signatur')" for c in "tabc")
_hashes = " OR ".join(f"regexp_matches({c}, ' ({_WORDS['hash']}) function')" for c in "tabc")
_marked = lambda c: f"regexp_replace({c}, '\\b((?:{_WORDS['hash']})[^\\p{{L}}\\p{{N}}]+function[\\p{{L}}\\p{{N}}]*|encrypt[\\p{{L}}\\p{{N}}]*)', chr(1) || '\\1' || chr(2), 'gi')"
_add("fts_search", _papers(lambda p: _stemmed(p, Query(terms='"group signatures" OR homomorphic encrypt', limit=query.SEARCH_LIMIT))), f"SELECT {_row} FROM {sql.ANALYSED} WHERE {_groups} OR ({_any(' homomorph')} AND {_any(' encrypt')}) ORDER BY date DESC, id DESC LIMIT 20")
_add("fts_stemmed", _papers(lambda p: query.matching(query.searchable(p), Query(terms="committing signature", prefix=False)).select("id")), f"SELECT id FROM {sql.ANALYSED} WHERE {_one_of('commit')} AND {_one_of('signatur')}")
_add("fts_stemmed_prefix", _papers(lambda p: query.matching(query.searchable(p), Query(terms="homomorphically")).select("id")), f"SELECT id FROM {sql.ANALYSED} WHERE {_any(' homomorph')}")
_add("fts_highlight", _papers(lambda p: query.highlighted(_stemmed(p, Query(terms='"hash functions" encrypting', limit=query.SEARCH_LIMIT)), Query(terms='"hash functions" encrypting'))), f"SELECT {_row}, {_marked('title')} AS title_hl, {_marked('abstract')} AS abstract_hl FROM (SELECT * FROM {sql.ANALYSED} WHERE ({_hashes}) AND {_any(' encrypt')} ORDER BY date DESC, id DESC LIMIT 20)")


def _indexed(s: SparkSession, d: str) -> DataFrame:
    path = f"{own_folder(s)}/index-{uuid.uuid4().hex}"
    analysed = query.searchable(table(s, d, "papers"), stemmed=False)
    postings.build(analysed, path, buckets=8)
    return postings.indexed(analysed, s.read.parquet(path), Query(terms="homomorphic OR lattice based", prefix=False), stemmed=False, buckets=8).select("id", "title")


_add("fts_indexed", _indexed, f"SELECT id, title FROM {sql.ANALYSED} WHERE {_any(' homomorphic ')} OR ({_any(' lattice ')} AND {_any(' based ')})")
_add("fts_count", _papers(lambda p: query.count(query.searchable(p, False), Query(terms="encryption", prefix=False, limit=5), stemmed=False)), f"SELECT count(*) AS n FROM {sql.ANALYSED} WHERE {_any(' encryption ')}")
_add("highlight_words", _papers(lambda p: p.select("id", mark_words("title", ["encryption", "proofs"]).alias("marked"))), "SELECT id, trim(regexp_replace(regexp_replace(' ' || title || ' ', '([^\\p{L}\\p{N}])(encryption|proofs)([^\\p{L}\\p{N}])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'gi'), '^ | $', '', 'g')) AS marked FROM papers")

# -- filters, order, lookups, counts ---------------------------------------------------

_page = "id, title, authors, abstract, category, date, year, rights, url"
for _name, _query, _where in (
    ("filter_year", Query(year=2019), "year = 2019"),
    ("filter_range", Query(since=dates.parse_range("2015..03/2018", NOW)[0], before=dates.parse_range("2015..03/2018", NOW)[1]), "date >= '2015-01-01' AND date < '2018-04-01'"),
    ("filter_before", Query(before="2003-06-01"), "date < '2003-06-01'"),
    ("filter_added", Query(added_after="2024-06-01 00:00:00"), "added > TIMESTAMP '2024-06-01'"),
    ("filter_category", Query(category="key crypto"), "contains(lower(category), 'key crypto')"),
):
    _add(_name, _papers(lambda p, q=_query: query.matching(p, q).select("id", "date", "category")), f"SELECT id, date, category FROM papers WHERE {_where}")
_author_sql = f"len(list_filter(list_transform(string_split(authors, ';'), lambda x: string_split({sql.fold('x')}, ' ')), lambda w: len(list_filter(w, lambda y: starts_with(y, 'lopez') OR starts_with(y, 'tins'))) > 0 AND len(list_filter(w, lambda y: starts_with(y, 'gunther'))) > 0 AND len(list_filter(w, lambda y: starts_with(y, 'tins'))) > 0)) > 0"
_add("filter_author", _papers(lambda p: query.matching(p, Query(author="Tinsuadez G. Günther")).select("id", "authors")), f"SELECT id, authors FROM papers WHERE {_author_sql}")
_add("browse_latest", _papers(lambda p: query.search(p, Query(limit=50))), f"SELECT {_page} FROM papers ORDER BY date DESC, id DESC LIMIT 50")
_add("browse_all", _papers(lambda p: query.search(p, Query(year=2021))), f"SELECT {_page} FROM papers WHERE year = 2021")
_add("get_paper", _papers(lambda p: query.get(p, "2019/16")), f"SELECT {_page} FROM papers WHERE id = '2019/16'")
_add("titles_of", _papers(lambda p: query.titles(p, ["2019/16", "2020/12", "1900/1"])), "SELECT id, title FROM papers WHERE id IN ('2019/16', '2020/12', '1900/1')")
_add("titles_or_names", lambda s, d: query.titled(table(s, d, "cdc_records").select(F.trim("id").alias("id"), F.col("op").alias("name_title")).filter("id <> ''").distinct(), table(s, d, "papers")), "SELECT r.id, coalesce(p.title, r.name_title) AS title FROM (SELECT DISTINCT trim(id, ' ') AS id, op AS name_title FROM cdc_records WHERE trim(id, ' ') <> '') r LEFT JOIN papers p ON p.id = r.id")
_add("category_histogram", _papers(query.categories), "SELECT category, count(*) AS n FROM papers WHERE category <> '' GROUP BY category")
_add("newest_paper", _papers(query.newest), "SELECT id, date FROM papers ORDER BY date DESC, id DESC LIMIT 1")
_add("favourite_author", _papers(lambda p: p.filter(biblio.has_author("authors", "FJADLIESTON")).select("id")), "SELECT id FROM papers WHERE len(list_filter(string_split(authors, ';'), lambda x: contains(lower(x), 'fjadlieston'))) > 0")
_add("suggest_categories", _papers(lambda p: suggest.suggest_categories(p, "CRYPT")), "SELECT category, count(*) AS n FROM papers WHERE category <> '' AND contains(lower(category), 'crypt') GROUP BY category ORDER BY n DESC, category LIMIT 40")

# -- names -----------------------------------------------------------------------------

_add("fold_names", lambda s, d: table(s, d, "author_names").select("name_id", names.fold_name("name").alias("folded"), names.skeleton(names.fold_name("name")).alias("bones")), f"SELECT name_id, {sql.fold('name')} AS folded, {sql.skeleton(sql.fold('name'))} AS bones FROM author_names")
_add("fold_bylines", _papers(lambda p: p.select("id", names.fold_name("authors").alias("authors_fold"))), f"SELECT id, {sql.fold('authors')} AS authors_fold FROM papers")
_add("deaccent_names", lambda s, d: table(s, d, "author_names").select("name_id", names.deaccent("name").alias("plain")), f"SELECT name_id, {sql.deaccent('name')} AS plain FROM author_names")
_add("split_surnames", lambda s, d: table(s, d, "author_names").select("name_id", names.split_surname("name")["rest"].alias("rest"), names.split_surname("name")["surname"].alias("surname")), "SELECT name_id, CASE WHEN len(w) > 1 THEN array_to_string(w[:-2], ' ') END AS rest, CASE WHEN len(w) > 1 THEN w[-1] END AS surname FROM (SELECT name_id, regexp_split_to_array(trim(name), '\\s+') AS w FROM author_names)")
_add("person_forms", lambda s, d: table(s, d, "author_names").select("name_id", names.person_form_column("name").alias("form")), "SELECT name_id, CASE WHEN len(p) = 2 AND trim(p[1]) <> '' AND trim(p[2]) <> '' THEN trim(p[2]) || ' ' || trim(p[1]) ELSE name END AS form FROM (SELECT name_id, name, string_split(name, ',') AS p FROM author_names)")
_keys = f"""
WITH keys AS (
  SELECT DISTINCT 'stray' AS kind, {sql.fold('stray')} AS key, representative FROM aliases WHERE stray IS NOT NULL
  UNION SELECT DISTINCT 'skeleton', {sql.skeleton(sql.fold('representative'))}, representative FROM aliases
), sole AS (SELECT kind, key, min(representative) AS r FROM keys WHERE key <> '' GROUP BY kind, key HAVING count(DISTINCT representative) = 1)
"""
_add("canonical_names", lambda s, d: byline.canonical_names(table(s, d, "author_names").select("name_id", "name"), table(s, d, "aliases")), f"{_keys} SELECT name_id, name, coalesce(s.r, k.r) AS canonical FROM author_names n LEFT JOIN sole s ON s.kind = 'stray' AND s.key = {sql.fold('n.name')} LEFT JOIN sole k ON k.kind = 'skeleton' AND k.key = {sql.skeleton(sql.fold('n.name'))}")
_add("fold_needle", lambda s, d: byline.canonical_needles(table(s, d, "author_names").select("name_id", "name"), table(s, d, "aliases")), f"{_keys} SELECT name_id, name, {sql.fold('coalesce(s.r, k.r, n.name)')} AS needle FROM author_names n LEFT JOIN sole s ON s.kind = 'stray' AND s.key = {sql.fold('n.name')} LEFT JOIN sole k ON k.kind = 'skeleton' AND k.key = {sql.skeleton(sql.fold('n.name'))}")
_form = "CASE WHEN len(string_split(name, ',')) = 2 AND trim(string_split(name, ',')[1]) <> '' AND trim(string_split(name, ',')[2]) <> '' THEN trim(string_split(name, ',')[2]) || ' ' || trim(string_split(name, ',')[1]) ELSE trim(name) END"
_add("person_canonical", lambda s, d: byline.canonical_persons(table(s, d, "author_names").select("name_id", "name"), table(s, d, "aliases")), f"{_keys} SELECT name_id, name, coalesce(s.r, k.r, n.form) AS person FROM (SELECT name_id, name, {_form} AS form FROM author_names) n LEFT JOIN sole s ON s.kind = 'stray' AND s.key = {sql.fold('n.form')} LEFT JOIN sole k ON k.kind = 'skeleton' AND k.key = {sql.skeleton(sql.fold('n.form'))}")
_bylines = f"""{_keys}, named AS (SELECT id, authors, {sql.names('authors')} AS ns FROM papers),
parts AS (SELECT id, unnest(ns) AS name, generate_subscripts(ns, 1) AS pos FROM named),
spelled AS (SELECT p.id, p.pos, coalesce(s.r, k.r, p.name) AS name FROM parts p LEFT JOIN sole s ON s.kind = 'stray' AND s.key = {sql.fold('p.name')} LEFT JOIN sole k ON k.kind = 'skeleton' AND k.key = {sql.skeleton(sql.fold('p.name'))}),
canon AS (SELECT n.id, n.authors, coalesce(string_agg(s.name, '; ' ORDER BY s.pos), '') AS canonical FROM named n LEFT JOIN spelled s ON s.id = n.id GROUP BY n.id, n.authors)
"""
_add("canonical_bylines", lambda s, d: byline.canonical_bylines(table(s, d, "papers"), table(s, d, "aliases")), f"{_bylines} SELECT id, authors, canonical FROM canon")
_add("changed_bylines", lambda s, d: byline.changed_bylines(table(s, d, "papers"), table(s, d, "aliases")), f"{_bylines} SELECT id, canonical AS authors, {sql.fold('canonical')} AS authors_fold FROM canon WHERE canonical <> authors")
_add("alias_fingerprint", lambda s, d: byline.alias_fingerprint(table(s, d, "aliases")))
_add(
    "suggest_authors",
    _papers(lambda p: suggest.suggest_authors(p, "tins")),
    f"""
WITH names AS (SELECT DISTINCT id, unnest({sql.names('authors')}) AS name FROM papers),
hits AS (SELECT id, name, {sql.deaccent('name')} AS plain FROM names WHERE len(list_filter(list_transform(string_split(name, ';'), lambda x: string_split({sql.fold('x')}, ' ')), lambda w: len(list_filter(w, lambda y: starts_with(y, 'tins'))) > 0)) > 0),
top AS (SELECT plain, count(DISTINCT id) AS papers, arg_min(name, (name = plain, name)) AS name FROM hits GROUP BY plain ORDER BY papers DESC, plain LIMIT 40),
forms AS (SELECT DISTINCT papers, unnest([CASE WHEN len(w) > 1 THEN w[-1] || ', ' || array_to_string(w[:-2], ' ') END, name]) AS value FROM (SELECT papers, name, regexp_split_to_array(trim(name), '\\s+') AS w FROM top)),
folded AS (SELECT papers, value, {sql.fold('value')} AS f FROM forms WHERE value IS NOT NULL)
SELECT value, papers FROM folded WHERE contains(f, 'tins') ORDER BY NOT starts_with(f, 'tins'), papers DESC, value LIMIT 40
""",
)

# -- bibliographic texts ---------------------------------------------------------------

_add("norm_titles", lambda s, d: table(s, d, "bib_entries").select("key", biblio.norm_title("title").alias("t"), biblio.surnames("author").alias("s")), f"SELECT key, {sql.norm_title('title')} AS t, {sql.surnames('author')} AS s FROM bib_entries")
_add("paper_ids", lambda s, d: table(s, d, "bib_entries").select("key", biblio.paper_id_in("howpublished").alias("paper_id")), "SELECT key, nullif(regexp_extract(howpublished, '(\\d{4}/\\d+)', 1), '') AS paper_id FROM bib_entries")
_add("id_parts", lambda s, d: table(s, d, "cdc_records").select("seq", biblio.is_paper_id("id").alias("valid"), biblio.normal_id("id", 2026).alias("id"), biblio.split_id("id")["year"].alias("y"), biblio.split_id("id")["number"].alias("n")), "SELECT seq, regexp_matches(id, '^[0-9]{4}/[0-9]+$') AS valid, CASE WHEN regexp_full_match(trim(id, ' '), '\\d+') THEN '2026/' || trim(id, ' ') ELSE regexp_replace(regexp_replace(trim(id, ' '), '^https?://[^/]+/', ''), '\\.pdf$', '') END AS id, TRY_CAST(nullif(regexp_extract(id, '^(\\d{4})[/-](\\d{1,9})', 1), '') AS INTEGER) AS y, TRY_CAST(nullif(regexp_extract(id, '^(\\d{4})[/-](\\d{1,9})', 2), '') AS INTEGER) AS n FROM cdc_records")
_words = "list_filter(regexp_split_to_array(x, '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))"
_arr = "list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x, ' ')), lambda x: x <> '')"
_last = f"list_transform({_arr}, lambda x: CASE WHEN len({_words}) > 0 THEN ({_words})[-1] ELSE x END)"
_add("short_authors", _papers(lambda p: p.select("id", biblio.short_authors("authors").alias("short"), biblio.full_authors("authors").alias("full"))), f"SELECT id, CASE WHEN len(n) = 0 THEN '—' WHEN len(n) <= 3 THEN array_to_string(l, ', ') ELSE array_to_string(l[1:2], ', ') || ' et al.' END AS short, CASE WHEN len(n) = 0 THEN '—' ELSE array_to_string(n, ', ') END AS full FROM (SELECT id, {_arr} AS n, {_last} AS l FROM papers)")
_add("short_licenses", _papers(lambda p: p.select("id", biblio.short_license("rights").alias("license"))), "SELECT id, CASE WHEN contains(rights, 'publicdomain/zero') THEN 'CC0' WHEN regexp_extract(rights, 'licen[cs]es[^/]*/(?:[^/]*/)?([a-z]{2}(?:-[a-z]{2})*)/(\\d[\\d.]*)', 1) <> '' THEN 'CC-' || upper(regexp_extract(rights, 'licen[cs]es[^/]*/(?:[^/]*/)?([a-z]{2}(?:-[a-z]{2})*)/(\\d[\\d.]*)', 1)) || '-' || regexp_extract(rights, 'licen[cs]es[^/]*/(?:[^/]*/)?([a-z]{2}(?:-[a-z]{2})*)/(\\d[\\d.]*)', 2) ELSE left(rights, 24) END AS license FROM papers")
_add("paragraphs", lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(biblio.paragraphs("text")).alias("pos", "paragraph")), "SELECT doc_id, (i - 1)::INTEGER AS pos, p AS paragraph FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\r\\n?', E'\\n', 'g'), '\\n[ \\t]*(?:\\n[ \\t]*)+'), lambda b: trim(regexp_replace(b, '\\s*\\n\\s*', ' ', 'g'), ' ')), lambda b: b <> '') AS ps FROM documents))")
_add("wrap_counts", _papers(lambda p: p.select("id", biblio.wrap_count("abstract", 40).alias("lines"))), "SELECT id, CASE WHEN len(w) = 0 THEN 0 ELSE list_reduce(list_transform(w, lambda x: struct_pack(n := 1, used := length(x)::INTEGER)), lambda a, b: CASE WHEN a.used + 1 + b.used <= 40 THEN struct_pack(n := a.n, used := a.used + 1 + b.used) ELSE struct_pack(n := a.n + 1, used := b.used) END).n END AS lines FROM (SELECT id, list_filter(regexp_split_to_array(abstract, '\\s+'), lambda x: x <> '') AS w FROM papers)")
_add("file_names", _papers(lambda p: p.select("id", biblio.file_name("id", "title").alias("name"), biblio.slug_words(biblio.file_name("id", "title")).alias("words"))), f"SELECT id, printf('%04d-%04d', y, n) || CASE WHEN slug = '' THEN '' ELSE '-' || slug END || '.pdf' AS name, replace(slug, '-', ' ') AS words FROM (SELECT id, regexp_extract(id, '^(\\d{{4}})/', 1)::INTEGER AS y, regexp_extract(id, '/(\\d+)$', 1)::INTEGER AS n, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w[1:6], lambda a, b: CASE WHEN length(a) > 60 THEN a ELSE a || '-' || b END) END AS slug FROM (SELECT id, list_filter(string_split({sql.norm_title('title')}, ' '), lambda x: x <> '') AS w FROM papers))")
_name = lambda: F.concat(F.replace("id", F.lit("/"), F.lit("-")), F.lit(".pdf"))
_add("file_checks", _papers(lambda p: p.select("id", biblio.visible_length(F.concat(F.lit("\x1b[1m\x01"), "title", F.lit("\x02\x1b[0m"))).alias("seen"), biblio.names_paper(_name(), 2019, 16).alias("named"), biblio.claims_other_year(_name(), 2019).alias("other"), biblio.megabytes(F.octet_length("abstract") * 10000).alias("size"))), "SELECT id, length(title)::INTEGER AS seen, list_contains(list_transform(g, lambda x: x::BIGINT), 16) AND NOT other AS named, other, printf('%.1f MB', strlen(abstract) * 10000 / 1e6) AS size FROM (SELECT *, len(list_filter(g, lambda x: regexp_matches(x, '^(19|20)[0-9][0-9]$'))) > 0 AND NOT list_contains(g, '2019') AS other FROM (SELECT *, regexp_extract_all(id, '\\d+') AS g FROM papers))")
_add("display_dates", _papers(lambda p: p.select("id", dates.display_date("date").alias("shown"), dates.format_iso(dates.parse_iso("date")).alias("iso"), dates.epoch_day(dates.parse_iso("date")).alias("day"), dates.human_age((F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(dates.parse_iso("date").cast("timestamp")))).alias("age"))), "SELECT id, CASE WHEN regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}') THEN regexp_replace(left(date, 10), '^(\\d{4})-(\\d{2})-(\\d{2})$', '\\3/\\2/\\1') ELSE date END AS shown, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS day, CASE WHEN s < 90 THEN 'just now' WHEN s < 5400 THEN (s // 60) || ' minutes ago' WHEN s < 172800 THEN (s // 3600) || ' hours ago' WHEN s IS NOT NULL THEN (s // 86400) || ' days ago' END AS age FROM (SELECT id, date, ts, date_diff('second', ts, TIMESTAMP '2025-02-01') AS s FROM (SELECT id, date, CASE WHEN length(date) >= 19 THEN TRY_CAST(left(date, 19) AS TIMESTAMP) WHEN length(date) >= 10 THEN TRY_CAST(left(date, 10) AS TIMESTAMP) END AS ts FROM papers))")
_add("json_export", _papers(json_rows), "SELECT id, to_json(struct_pack(id := id, title := title, authors := list_filter(string_split(authors, '; '), lambda x: x <> ''), abstract := abstract, category := category, date := date, year := year, license := rights, url := url))::VARCHAR AS json FROM papers")

# -- change feed, arrivals, standing queries -------------------------------------------

_id = "nullif(trim(list_last(string_split(id, ':')), E' \\t\\n\\r'), '')"
_add("cdc_state", lambda s, d: merge_state(None, table(s, d, "cdc_records")).select("id", "op", "changed_at", "seq"), f"""
WITH changes AS (
  SELECT {_id} AS id, op, changed_at, min(seq) AS seq FROM cdc_records
  GROUP BY 1, op, changed_at, title, rights, creators, descriptions, subjects, dates, identifiers
)
SELECT id, op, changed_at, seq FROM changes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY changed_at DESC, seq DESC) = 1""")
_add("cdc_first_seen", lambda s, d: first_seen(table(s, d, "cdc_records")), f"WITH r AS (SELECT {_id} AS id, op, changed_at, seq, received_at FROM cdc_records), dead AS (SELECT id, max((changed_at, seq)) AS x FROM r WHERE op = 'deleted' GROUP BY id) SELECT r.id, arg_min(r.received_at, (r.changed_at, r.seq)) AS added FROM r LEFT JOIN dead ON dead.id = r.id WHERE r.id IS NOT NULL AND r.op = 'live' AND (dead.x IS NULL OR (r.changed_at, r.seq) > dead.x) GROUP BY r.id")
_add("incremental_window", _papers(lambda p: feed.incremental_from(p, datetime(2025, 1, 14))), "SELECT least(TIMESTAMP '2025-01-14', max(TRY_CAST(left(date, 19) AS TIMESTAMP))) - INTERVAL 2 DAY AS start FROM papers")
_feed_columns = ("id", "added", "date")
_add("feed_since", _papers(lambda p: feed.since(p, datetime(2024, 12, 20)).select(*_feed_columns)), "SELECT id, added, date FROM papers WHERE added > TIMESTAMP '2024-12-20' ORDER BY added DESC, date DESC, id DESC LIMIT 500")
_add("feed_floor", _papers(lambda p: feed.feed(p, feed.FeedState(datetime(2030, 1, 1)), datetime(2030, 1, 2)).rows.select(*_feed_columns)), "SELECT id, added, date FROM papers WHERE added IS NOT NULL ORDER BY added DESC, date DESC, id DESC LIMIT 10")
_batch = "SELECT id, added, date FROM papers WHERE added > TIMESTAMP '2024-12-01' ORDER BY added DESC, date DESC, id DESC LIMIT 500"
_seen = feed.FeedState(datetime(2030, 1, 1), datetime(2024, 12, 1))
_enough = f"(SELECT count(*) FROM ({_batch})) >= 10"
_replayed = f"(SELECT * FROM ({_batch}) WHERE {_enough} UNION ALL SELECT * FROM (SELECT id, added, date FROM papers WHERE added IS NOT NULL ORDER BY added DESC, date DESC, id DESC LIMIT 10) WHERE NOT {_enough})"
_add("feed_replay", _papers(lambda p: feed.feed(p, _seen, datetime(2030, 1, 2)).rows.select(*_feed_columns)), f"SELECT * FROM {_replayed}")
_add("feed_limit", _papers(lambda p: feed.feed(p, _seen, datetime(2030, 1, 2), limit=3).rows.select(*_feed_columns)), f"SELECT * FROM {_replayed} ORDER BY added DESC, date DESC, id DESC LIMIT 3")
_add("feed_label", _papers(lambda p: p.sparkSession.createDataFrame([(feed.feed(p, _seen, datetime(2030, 1, 2)).label,)], "label string")), f"SELECT CASE WHEN {_enough} THEN 'last batch, from ' || strftime((SELECT max(added) FROM papers), '%Y-%m-%d %H:%M') ELSE 'nothing new since 2030-01-01 00:00' END AS label")
WATCHES = [watch.Watch.make('"hash functions"'), watch.Watch.make(author="Tinsuadez, Günther"), watch.Watch.make("encryption", category="protocols"), watch.Watch.make("signatures", scope="title")]
_hash, _tins, _enc, _sig = (w.label() for w in WATCHES)
_hits = f"""
SELECT id, '{_hash}' AS label FROM {sql.ANALYSED} WHERE {_any(' hash functions')}
UNION ALL SELECT id, '{_tins}' FROM papers WHERE {_author_sql}
UNION ALL SELECT id, '{_enc}' FROM {sql.ANALYSED} WHERE {_any(' encryption')} AND contains(lower(category), 'protocols')
UNION ALL SELECT id, '{_sig}' FROM {sql.ANALYSED} WHERE contains(t, ' signatures') OR contains(a, ' signatures')
"""


def _watch_hits(s: SparkSession, d: str) -> DataFrame:
    return watch.match_all(query.searchable(table(s, d, "papers"), stemmed=False), WATCHES, stemmed=False)


_add("watch_hits", _watch_hits, _hits)
_add("watch_counts", lambda s, d: watch.counts(_watch_hits(s, d)), f"SELECT label, count(*) AS n FROM ({_hits}) GROUP BY label")
_add("watch_listing", lambda s, d: watch.listing(_watch_hits(s, d), WATCHES).select("number", "label", "n"), f"SELECT w.number::INTEGER AS number, w.label, count(h.id) AS n FROM (VALUES (1, '{_hash}'), (2, '{_tins}'), (3, '{_enc}'), (4, '{_sig}')) w(number, label) LEFT JOIN ({_hits}) h ON h.label = w.label GROUP BY 1, 2")
_add("only_watched", lambda s, d: query.matching(table(s, d, "papers"), Query(only_watched=True, year=2022), _watch_hits(s, d)).select("id"), f"SELECT id FROM papers WHERE year = 2022 AND id IN (SELECT id FROM ({_hits}))")
_add("watch_sync", lambda s, d: watch.sync(_watch_hits(s, d), query.searchable(table(s, d, "papers"), False), WATCHES[1:], [_hash, _tins, _enc], stemmed=False), f"SELECT id, label FROM ({_hits}) WHERE label <> '{_hash}'")

# -- sources: what queries write and read again ------------------------------------------


def _bibtex(s: SparkSession, d: str) -> DataFrame:
    """All bibliography entries as BibTeX files, read again."""
    path = f"{own_folder(s)}/bib-{uuid.uuid4().hex}"
    table(s, d, "bib_entries").select(F.coalesce("raw", F.lit("")).alias("value")).write.text(path)
    return bibtex.read_bibtex(s, path).select("key", "howpublished").distinct()


_add("bibtex_entries", _bibtex, "SELECT DISTINCT key, trim(regexp_extract(raw, 'howpublished\\s*=\\s*[{\"]([^}\"]*)', 1)) AS howpublished FROM bib_entries WHERE raw LIKE '@%' AND length(replace(raw, '{', '')) = length(replace(raw, '}', ''))")


def _oai(s: SparkSession, d: str) -> DataFrame:
    """All records of the feed as pages of XML, read again."""
    feed_ = table(s, d, "cdc_records")
    header = F.struct(F.when(F.col("op") == "deleted", "deleted").alias("_status"), F.col("id").alias("identifier"), F.col("seq").cast("string").alias("datestamp"))
    dc = F.struct(F.array("title").alias("title"), F.col("creators").alias("creator"), F.col("descriptions").alias("description"), F.col("subjects").alias("subject"), F.col("dates").alias("date"), F.col("identifiers").alias("identifier"), F.array("rights").alias("rights"))
    path = f"{own_folder(s)}/oai-{uuid.uuid4().hex}"
    feed_.select(header.alias("header"), F.struct(dc.alias("dc")).alias("metadata")).write.format("xml").option("rootTag", "ListRecords").option("rowTag", "record").save(path)
    return oai.read_pages(s, path).select(F.col("datestamp").cast("long").alias("seq"), "op", F.trim("id").alias("id"), "title", F.size("creators").alias("creators"), F.array_join("dates", " ").alias("dates"))


_add("oai_records", _oai, "SELECT seq, op, trim(id, E' \\t\\n\\r') AS id, trim(title, E' \\t\\n\\r') AS title, coalesce(len(creators), 0)::INTEGER AS creators, coalesce(array_to_string(dates, ' '), '') AS dates FROM cdc_records WHERE trim(id, ' ') <> ''")

# -- links -----------------------------------------------------------------------------


def _links(s: SparkSession, d: str) -> DataFrame:
    papers, entries = table(s, d, "papers"), table(s, d, "bib_entries")
    return link.link_published(papers, entries).unionByName(link.link_preprints(papers, entries))


_links_sql = f"""
WITH l AS (SELECT id, {sql.norm_title('title')} AS t, year AS y, {sql.surnames("array_to_string(" + sql.names('authors') + ", ' and ')")} AS s FROM papers),
r AS (SELECT DISTINCT key, {sql.norm_title('title')} AS t, coalesce(TRY_CAST(nullif(regexp_extract(year, '(\\d+)', 1), '') AS INTEGER), 0) AS y, year, raw, {sql.surnames('author')} AS s FROM bib_entries WHERE key IS NOT NULL),
published AS (SELECT l.id AS paper_id, arg_min(struct_pack(key := r.key, year := r.year, entry := r.raw), (CASE WHEN l.y <= 0 OR r.y <= 0 THEN 99 ELSE abs(l.y - r.y) END, r.key)) AS x FROM l JOIN r ON l.t = r.t AND l.t <> '' AND list_has_any(l.s, r.s) GROUP BY l.id),
preprint AS (SELECT nullif(regexp_extract(howpublished, '(\\d{{4}}/\\d+)', 1), '') AS paper_id, arg_max(struct_pack(key := key, year := year, entry := raw), (key, year, raw)) AS x FROM bib_entries WHERE key IS NOT NULL GROUP BY 1),
links AS (SELECT paper_id, x.key AS key, 'published' AS kind, x.year AS year, x.entry AS entry FROM published UNION ALL SELECT paper_id, x.key, 'preprint', x.year, x.entry FROM preprint WHERE paper_id IN (SELECT id FROM papers)),
best AS (SELECT paper_id, arg_max(struct_pack(key := key, is_published := kind = 'published', entry := entry), (kind = 'published', key)) AS x FROM links GROUP BY paper_id)
"""
_add("links", _links, f"{_links_sql} SELECT * FROM links")
def _upserted(s: SparkSession, d: str) -> DataFrame:
    """Every link sent twice, the second time under another key."""
    links = _links(s, d).withColumn("n", F.lit(1))
    return link.upsert_links(links.unionByName(links.withColumns({"n": F.lit(2), "key": F.concat(F.lit("new:"), "key")})), "n")


_add("links_upserted", _upserted, f"{_links_sql} SELECT paper_id, 'new:' || key AS key, kind, year, entry, 2 AS n FROM links")
_add("link_published", lambda s, d: link.link_published(table(s, d, "papers"), table(s, d, "bib_entries")).select("paper_id", "key", "year"), f"{_links_sql} SELECT paper_id, key, year FROM links WHERE kind = 'published'")
_add("best_links", lambda s, d: link.best_links(_links(s, d)), f"{_links_sql} SELECT paper_id, x.key AS key, x.is_published AS is_published, x.entry AS entry FROM best")
_add("papers_with_links", lambda s, d: link.with_links(table(s, d, "papers").select("id", "title"), _links(s, d)).withColumn("key", biblio.citation_key("key", "id")), f"{_links_sql} SELECT id, title, coalesce(x.key, 'preprint:' || id) AS key, x.is_published AS is_published FROM papers LEFT JOIN best ON paper_id = id")
_add("link_coverage", lambda s, d: link.coverage(table(s, d, "papers"), _links(s, d)), f"{_links_sql} SELECT (SELECT count(*) FROM papers) AS papers, count(DISTINCT paper_id) AS linked, count(DISTINCT paper_id) FILTER (kind = 'published') AS published, round(100 * count(DISTINCT paper_id) / (SELECT count(*) FROM papers), 1) AS linked_percent, round(100 * count(DISTINCT paper_id) FILTER (kind = 'published') / count(DISTINCT paper_id), 1) AS published_percent FROM links")
_add("status", lambda s, d: query.status(table(s, d, "papers"), _links(s, d), {"last_harvest": "2025-01-14"}), f"{_links_sql} SELECT (SELECT count(*) FROM papers) AS papers, (SELECT max(date) FROM papers) AS newest, count(*) AS links, count(*) FILTER (kind = 'published') AS published, count(DISTINCT paper_id) AS linked, '2025-01-14' AS last_harvest FROM links")
