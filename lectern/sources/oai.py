"""OAI-PMH: pages of a change feed as files or over the network.

Saved pages are read by Spark's XML source with an explicit schema.  The network source is
a Python data source whose reader follows resumption tokens; it writes nothing itself, so
what it yields is the same feed as that of saved pages.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.sources.files import State

ATTEMPTS, LONGEST_WAIT, PAUSE = 4, 30.0, 0.2
#: The state's name for the server's time of the last harvest.
LAST_HARVEST = "last_harvest"
_LISTS = {"creators": "creator", "descriptions": "description", "subjects": "subject", "dates": "date", "identifiers": "identifier"}
_TEXTS = T.ArrayType(T.StringType())
RECORD = T.StructType([T.StructField(x, T.StringType()) for x in ("op", "id", "datestamp", "title", "rights")] + [T.StructField(x, _TEXTS) for x in _LISTS])
_DC = T.StructType([T.StructField(x, _TEXTS) for x in ("title", "creator", "description", "subject", "date", "identifier", "rights")])
_HEADER = T.StructType([T.StructField("_status", T.StringType()), T.StructField("identifier", T.StringType()), T.StructField("datestamp", T.StringType())])
_XML = T.StructType([T.StructField("header", _HEADER), T.StructField("metadata", T.StructType([T.StructField("dc", _DC)]))])


def url_quote(text: str) -> str:
    """Everything but unreserved characters as ``%XX``."""
    return urllib.parse.quote(text, safe="")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The records of saved pages in the shape of the change feed: the last title and
    rights, all values of the other elements, ``op`` from the header's status.  A page
    that says nothing matches is empty; a page with any other error is raised, before
    anything is read."""
    errors = spark.read.format("xml").option("rowTag", "error").option("ignoreNamespace", "true").schema("_code string, _VALUE string").load(path)
    wrong = errors.filter(F.coalesce("_code", F.lit("")) != "noRecordsMatch").first()
    if wrong is not None:
        raise RuntimeError(f"the server says: {(wrong['_VALUE'] or wrong['_code'] or '').strip()}")
    raw = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").schema(_XML).load(path)
    dc = F.col("metadata.dc")
    last = lambda name: F.when(F.size(dc[name]) > 0, F.trim(F.element_at(dc[name], -1)))
    op = F.when(F.col("header._status") == "deleted", F.lit("deleted")).otherwise(F.lit("live"))
    return raw.select(op.alias("op"), F.col("header.identifier").alias("id"), F.col("header.datestamp").alias("datestamp"), last("title").alias("title"), last("rights").alias("rights"), *[F.coalesce(F.filter(dc[e], lambda x: x.isNotNull()), F.array().cast(_TEXTS)).alias(c) for c, e in _LISTS.items()]).filter(F.trim(F.col("id")) != "")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_page(xml: str) -> tuple[list[tuple], str | None, str | None]:
    """(records in the order of :data:`RECORD`, resumption token, response date) of one
    page.  A page that says nothing matches is empty; any other error is raised."""
    root = ET.fromstring(xml)
    token = response = None
    records = []
    for node in root.iter():
        tag = _local(node.tag)
        if tag == "responseDate" and response is None:
            response = (node.text or "").strip() or None
        elif tag == "error":
            if node.get("code") != "noRecordsMatch":
                raise RuntimeError(f"the server says: {(node.text or node.get('code') or '').strip()}")
        elif tag == "resumptionToken":
            token = (node.text or "").strip() or None
        elif tag == "record":
            values: dict[str, list[str]] = {}
            header = next((x for x in node if _local(x.tag) == "header"), None)
            status = header.get("status") if header is not None else None
            head = {_local(x.tag): (x.text or "").strip() for x in header} if header is not None else {}
            for x in node.iter():
                if x is not header and _local(x.tag) in (*_LISTS.values(), "title", "rights") and x not in (header if header is not None else ()):
                    values.setdefault(_local(x.tag), []).append((x.text or "").strip())
            if not head.get("identifier"):
                continue
            last = lambda name: values[name][-1] if values.get(name) else None  # noqa: B023,E731
            records.append(("deleted" if status == "deleted" else "live", head["identifier"], head.get("datestamp"), last("title"), last("rights"), *[values.get(e, []) for e in _LISTS.values()]))
    return records, token, response


def fetch(url: str, opener: Callable[[str], str] | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
    """The text of an address: up to four attempts, waiting longer each time or as long
    as the server asks for, where it is busy; any other status fails at once."""
    for attempt in range(ATTEMPTS):
        try:
            if opener is not None:
                return opener(url)
            with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as error:
            if error.code not in (429, 503) or attempt == ATTEMPTS - 1:
                raise
            asked = (error.headers or {}).get("Retry-After", "")
            wait = float(asked) if str(asked).isdigit() else 2.0**attempt
        except urllib.error.URLError:
            if attempt == ATTEMPTS - 1:
                raise
            wait = 2.0**attempt
        sleep(min(wait, LONGEST_WAIT))
    raise RuntimeError("unreachable")


def pages(base: str, since: str | None = None, opener: Callable[[str], str] | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[list[tuple], str | None]]:
    """(records, response date) of every page, following the tokens."""
    query = "verb=ListRecords&metadataPrefix=oai_dc" + (f"&from={url_quote(since)}" if since else "")
    while True:
        records, token, response = parse_page(fetch(f"{base}?{query}", opener, sleep))
        yield records, response
        if not token:
            return
        query = f"verb=ListRecords&resumptionToken={url_quote(token)}"
        sleep(PAUSE)


def harvest(base: str, state: State, keep: Callable[[list[tuple]], None], full: bool = False, opener: Callable[[str], str] | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Hands every page's records to ``keep`` and returns their number.  Starts from the
    time the server gave at the last harvest; the time of this one's first page is stored
    after the last page, so a harvest that fails is repeated."""
    began, n = None, 0
    for k, (records, response) in enumerate(pages(base, None if full else state.get(LAST_HARVEST), opener, sleep)):
        began = response if not k else began
        keep(records)
        n += len(records)
    if began:
        state.set({LAST_HARVEST: began})
    return n


class OaiReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base, self.since = options["url"], options.get("from")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # tokens chain the pages

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for records, _ in pages(self.base, self.since):
            yield from records


class OaiSource(DataSource):
    """``spark.dataSource.register(OaiSource)``, then ``spark.read.format("oai")`` with the
    options ``url`` and, for an increment, ``from``."""

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> T.StructType:
        return RECORD

    def reader(self, schema: T.StructType) -> OaiReader:
        return OaiReader(self.options)
