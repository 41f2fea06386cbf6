"""Settings, state, folders of papers, and JSON output."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.biblio import split_id
from lectern.operators import cdc
from lectern.operators.watch import Watch, parse_watch

#: Settings that are numbers above zero, and those that are text.
NUMBERS = ("limit", "feed_floor")
TEXTS = ("scope", "favourite", "pager", "theme")
_COMMENT = re.compile(r"(?:^|(?<=\s))#.*")


def parse_config(text: str) -> tuple[dict[str, object], list[Watch]]:
    """Settings and watches of ``key = value`` lines.  ``#`` starts a comment, in a watch
    only after white space and not after a backslash, which it loses; watches repeat;
    unknown keys and numbers that are none, or zero, are ignored."""
    settings: dict[str, object] = {}
    watches: list[Watch] = []
    for line in text.splitlines():
        whole = line
        key, eq, value = (x.strip() for x in line.partition("#")[0].partition("="))
        if not eq:
            continue
        if key == "watch":
            watch = parse_watch(_COMMENT.sub("", whole.partition("=")[2]).replace("\\#", "#").strip())
            watches += [watch] if watch else []
        elif key in NUMBERS and value.isdigit() and int(value):
            settings[key] = int(value)
        elif key in TEXTS:
            settings[key] = value
    return settings, watches


def set_watches(text: str, watches: list[Watch]) -> str:
    """The configuration with these watches in place of its own; other lines stay."""
    kept = [line for line in text.splitlines() if line.partition("=")[0].strip() != "watch"]
    return "\n".join([*kept, *("watch = " + w.label().replace("#", "\\#") for w in watches)]) + "\n"


class State:
    """A few named values in a JSON file, replaced as a whole."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def all(self) -> dict[str, str]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def get(self, key: str) -> str | None:
        return self.all().get(key)

    def set(self, values: Mapping[str, str]) -> None:
        draft = self.path.with_suffix(".new")
        draft.write_text(json.dumps(self.all() | dict(values), sort_keys=True))
        draft.replace(self.path)


def library(spark: SparkSession, path: str) -> DataFrame:
    """(id, year, number, name, size) of the papers in a folder, latest first.  Only
    names and sizes are read, not the files' content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
    parts = found.withColumn("p", split_id("name")).filter(F.col("p").isNotNull())
    return parts.select(F.concat_ws("/", F.format_string("%04d", "p.year"), F.col("p.number").cast("string")).alias("id"), "p.year", "p.number", "name", "size").orderBy(F.desc("year"), F.desc("number"))


def library_size(found: DataFrame) -> DataFrame:
    """One row: how many files a folder holds, and their bytes."""
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def json_rows(papers: DataFrame) -> DataFrame:
    """``json``: one object per paper with nine keys; authors as a list, the licence as
    stored."""
    authors = F.filter(F.split("authors", "; "), lambda a: a != "")
    fields = F.struct("id", "title", authors.alias("authors"), "abstract", "category", "date", "year", F.col("rights").alias("license"), "url")
    return papers.select("id", F.to_json(fields).alias("json"))


def replace_all(df: DataFrame, path: str) -> None:
    """Replaces a table as a whole, but never with nothing.  The new table is complete
    before it takes the old one's place; a run that is lost leaves the old one."""
    if df.isEmpty():
        raise ValueError("there is nothing to write; the table stays as it is")
    spark = df.sparkSession
    draft, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(draft)
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(at(path))
    if there and not fs.rename(at(path), at(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(at(draft), at(path)):
        raise OSError(f"cannot move {draft}")
    if there:
        fs.delete(at(old), True)


def replace_published(df: DataFrame, folder: str) -> str:
    """The same for a published table (``cdc.publish``), where readers see the old table
    or the new one at every moment."""
    if df.isEmpty():
        raise ValueError("there is nothing to write; the table stays as it is")
    return cdc.publish(df, folder)
