"""BibTeX files.

Spark splits a file at ``\\n@`` and so hands out entries without reading a file in one
task; an Arrow pass takes each entry apart, since braces nest.  Macros are few and
global: they are read first and go to the workers as a plain mapping.
"""

from __future__ import annotations

import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import written
from lectern.sources.files import State

FIELDS = ("title", "author", "year", "howpublished")
#: Nesting of macros that is followed; a cycle ends there.
DEPTH = 12
NAME_WIDTH = 13
#: Pieces that one entry may have been parted into; beyond it an entry counts as broken.
MOST_PIECES = 1000
#: The state's names for the validator of the file and the time of its last refresh.
ETAG, REFRESHED = "bib_etag", "bib_refreshed"
#: Macros of month names, which stay macros.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ENTRIES = T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "key", *FIELDS, "raw")])
_HEAD = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")


def _balanced(text: str, at: int) -> int:
    """The position after the brace that closes the one at ``at``; -1 if none does."""
    depth = 0
    for m in re.finditer(r"\\.|[{}]", text[at:]):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return at + m.end()
    return -1


def _value(text: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The ``#``-joined tokens of a value: (braced | quoted | bare, text)."""
    tokens = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            break
        if text[at] == "{":
            end = _balanced(text, at)
            if end < 0:
                return [], len(text)
            tokens.append(("braced", text[at + 1 : end - 1]))
            at = end
        elif text[at] == '"':
            end, depth = at + 1, 0
            while end < len(text) and not (text[end] == '"' and not depth):
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 2 if text[end] == "\\" else 1
            tokens.append(("quoted", text[at + 1 : end]))
            at = end + 1
        else:
            m = re.compile(r"[^\s,#{}\"]+").match(text, at)
            if not m:
                break
            tokens.append(("bare", m[0]))
            at = m.end()
        rest = re.compile(r"\s*#").match(text, at)
        if not rest:
            break
        at = rest.end()
    return tokens, at


def fields_of(body: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(name in lower case, value tokens) of an entry's fields, in order."""
    out, at = [], 0
    name = re.compile(r"\s*,?\s*([A-Za-z][\w\-]*)\s*=")
    while m := name.match(body, at):
        tokens, at = _value(body, m.end())
        out.append((m[1].lower(), tokens))
        skip = re.compile(r"[^,]*").match(body, at)
        at = skip.end() if skip else at
    return out


def expand(tokens: list[tuple[str, str]], macros: dict[str, str], depth: int = 0) -> str:
    """The text of a value: known macros by their value, unknown names as they stand."""
    if depth > DEPTH:
        return ""
    out = []
    for kind, text in tokens:
        value = macros.get(text.lower()) if kind == "bare" else None
        out.append(expand(_value(value, 0)[0], macros, depth + 1) if value is not None else text)
    return "".join(out)


def parse_entry(text: str, macros: dict[str, str] | None = None, compat: bool = False) -> dict | None:
    """One entry; None for text without a complete one.  ``compat`` reads only values in
    braces or quotes, and of joined values only the first part."""
    m = _HEAD.search(text)
    if not m or m[1].lower() in ("string", "comment", "preamble"):
        return None
    end = _balanced(text, m.end() - 1) if m[2] == "{" else text.rfind(")") + 1
    if end <= 0:
        return None
    key, _, body = text[m.end() : end - 1].partition(",")
    out: dict = {"kind": m[1].lower(), "key": key.strip(), "raw": text[m.start() : end]}
    found: dict[str, str] = {}
    for name, tokens in fields_of(body):
        if name in FIELDS and name not in found:
            if compat:
                tokens = tokens[:1] if tokens and tokens[0][0] != "bare" else []
            found[name] = expand(tokens, macros or {}).strip()
    return out | {f: found.get(f, "") for f in FIELDS}


def parse_macros(text: str) -> dict[str, str]:
    """Macro names in lower case and their value as written; the last of a name counts."""
    out = {}
    for m in re.finditer(r"@\s*[Ss][Tt][Rr][Ii][Nn][Gg]\s*([{(])", text):
        end = _balanced(text, m.end() - 1) if m[1] == "{" else text.find(")", m.end()) + 1
        body = text[m.end() : end - 1] if end > 0 else ""
        name, eq, value = body.partition("=")
        if eq:
            out[name.strip().lower()] = value.strip()
    return out


def rebuild(raw: str, macros: dict[str, str]) -> str:
    """An entry with its macros inlined: numbers and month names without braces, fields
    without a value left out, names padded."""
    m = _HEAD.search(raw)
    if not m:
        return raw
    end = _balanced(raw, m.end() - 1)
    key, _, body = raw[m.end() : (end if end > 0 else len(raw)) - 1].partition(",")
    lines = []
    for name, tokens in fields_of(body):
        bare = tokens[0][1].lower() if len(tokens) == 1 and tokens[0][0] == "bare" else ""
        if bare in MONTHS and bare not in macros:
            lines.append(f"  {name:<{NAME_WIDTH}}= {bare}")
            continue
        value = expand(tokens, macros).strip()
        if value:
            lines.append(f"  {name:<{NAME_WIDTH}}= {value}" if value.isdigit() else f"  {name:<{NAME_WIDTH}}= {{{value}}}")
    return f"@{m[1].lower()}{{{key.strip()},\n" + ",\n".join(lines) + "\n}"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between ``@`` at line starts; where such an ``@`` stands inside an entry's
    braces, what was parted is joined again."""
    raw = spark.read.option("lineSep", "\n@").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.concat(F.lit("@"), F.ltrim(F.regexp_replace("value", "^@", ""))).alias("value"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda c: F.length(plain) - F.length(F.replace(plain, F.lit(c), F.lit("")))
    opened = raw.withColumn("open", F.col("value").rlike(r"^@\s*[A-Za-z]+\s*\{") & (count("{") > count("}")))
    if opened.filter("open").isEmpty():
        return raw.select("value")
    order = Window.partitionBy("file").orderBy("id")
    placed = written(opened.withColumn("n", F.row_number().over(order)), "pieces")
    heads = placed.filter("open").select("file", F.col("n").alias("head"), F.explode(F.sequence("n", F.col("n") + MOST_PIECES)).alias("n"))
    runs = heads.join(placed.select("file", "n", "value"), ["file", "n"]).groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("run"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, head, run in zip(*(batch.column(c).to_pylist() for c in ("file", "head", "run"))):
                text, last = "", head
                for part in run:
                    text += ("\n" if text else "") + part["value"]
                    m, last = _HEAD.search(text), part["n"]
                    if m and _balanced(text, m.end() - 1) > 0:
                        break
                else:
                    text, last = run[0]["value"], head  # its braces never close
                out.append((file, head, last, text))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["file", "head", "last", "value"])

    joined = written(runs.mapInArrow(join, "file string, head int, last int, value string"), "joined")
    inner = joined.select("file", F.explode(F.sequence("head", "last")).alias("n"), F.col("head")).groupBy("file", "n").agg(F.min("head").alias("owner"))
    whole = joined.join(inner.select("file", F.col("n").alias("head"), "owner"), ["file", "head"]).filter("owner = head").select("value")
    return placed.join(inner, ["file", "n"], "left_anti").select("value").unionByName(whole)


def download(url: str, path: str, etag: str | None = None, opener: Callable | None = None) -> tuple[bool, str | None]:
    """(whether there was something new, its validator): fetches a BibTeX file in chunks
    into ``path``, unless the server says that it is as ``etag`` names it.  Bytes that are
    no UTF-8 are kept for the reader to replace; a failure leaves the old file."""
    request = urllib.request.Request(url, headers={"If-None-Match": etag} if etag else {})
    try:
        answer = (opener or urllib.request.urlopen)(request)
    except urllib.error.HTTPError as error:
        if error.code == 304:
            return False, etag
        raise
    with answer:
        if getattr(answer, "status", 200) == 304:
            return False, etag
        draft = Path(f"{path}.new")
        with draft.open("wb") as out:
            while chunk := answer.read(1 << 16):
                out.write(chunk)
        draft.replace(path)
        return True, answer.headers.get("ETag")


def refresh(url: str, path: str, state: State, rows: int, now: datetime, force: bool = False, opener: Callable | None = None) -> bool:
    """Brings the file up to date and says whether it changed.  The validator is sent only
    where there is a table to keep (``rows`` > 0) and nothing forces a download."""
    changed, etag = download(url, path, state.get(ETAG) if rows and not force else None, opener)
    state.set({REFRESHED: now.isoformat()} | ({ETAG: etag} if etag else {}))
    return changed


def read_macros(spark: SparkSession, path: str) -> dict[str, str]:
    """The macros of BibTeX files.  They name series and months, not works: their number
    does not grow with the entries."""
    rows = _pieces(spark, path).filter(F.col("value").rlike(r"(?i)^@\s*string")).toLocalIterator()
    out: dict[str, str] = {}
    for row in rows:
        out |= parse_macros(row.value)
    return out


def read_bibtex(spark: SparkSession, path: str, macros: dict[str, str] | None = None, compat: bool = False) -> DataFrame:
    """(kind, key, title, author, year, howpublished, raw), one row per entry; '' for what
    an entry does not have.  Text that is no complete entry gives no row."""
    known = macros if macros is not None else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [e for v in batch.column(0).to_pylist() if v and (e := parse_entry(v, known, compat))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in ENTRIES.names], names=ENTRIES.names)

    return _pieces(spark, path).mapInArrow(run, ENTRIES)


def rebuilt(entries: DataFrame, macros: dict[str, str]) -> DataFrame:
    """``entries`` with ``entry``: the source text with macros inlined."""
    schema = T.StructType([*entries.schema.fields, T.StructField("entry", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else rebuild(v, macros) for v in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return entries.mapInArrow(run, schema)
