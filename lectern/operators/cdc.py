"""Applying a feed of inserts, updates and deletes.

Each bucket of ids is rebuilt by an embedded DuckDB database: conditional conflict updates
keep, per id, the change with the greatest (time, sequence), whatever the order in which
records arrive; repeated deliveries collapse to their smallest sequence; deletions stay as
tombstones, so a late older change cannot bring a row back.  The snapshot takes part in
the same comparison as the row a change has to beat.

The same upsert runs before the shuffle, over each input partition: of an id that holds
a large share of the feed only its newest change (and what ties with it), its newest
tombstone and its first arrival are sent on.  What a record carries goes through the
bucket with it, so the result of a bucket is complete.  Bucket results are exported as
Arrow batches and published together: a new version is written whole and becomes current
by one atomic rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.names import fold_name
from lectern.session import written

LIVE, DELETED = "live", "deleted"
#: Further kinds of rows inside a bucket: the snapshot's own rows; an id's newest
#: tombstone and its first arrival, where they are not among its newest changes.
BASE, FALLEN, ARRIVED = "base", "fallen", "arrived"
PAYLOAD = ("title", "rights", "creators", "descriptions", "subjects", "dates", "identifiers")
#: Ids, and bytes of records, that a combiner holds before it hands its rows on and starts afresh.
COMBINER_IDS = 200_000
COMBINER_BYTES = 128 << 20
EARLIEST = -(1 << 63)
#: Parts of the records of ids that arrived again after a deletion.
SALTS = 8
#: The column of a bucketed table that names the bucket.
BUCKET = "bucket"

_KEY = [T.StructField("id", T.StringType()), T.StructField("op", T.StringType()), T.StructField("us", T.LongType()), T.StructField("payload", T.StringType()), T.StructField("seq", T.LongType())]
_RECEIVED = T.StructField("received", T.LongType())
_HISTORY = [T.StructField("known", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("old_added", "fallen_us", "fallen_seq", "first_received"))]


def canonical_id(column: Column | str) -> Column:
    """An id as the snapshot writes it: what follows the last colon, without white space
    around it; null where nothing is left."""
    part = F.element_at(F.split(column, ":"), -1)
    bare = F.regexp_replace(part, r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", bare)


def instant(column: Column | str) -> Column:
    """Microseconds since 1970 of an ISO instant or day in text; null if it is neither."""
    text = F.regexp_replace(F.trim(column), "Z$", "")
    return micros(F.when(text.rlike(r"^\d{4}-\d"), text).try_cast("timestamp_ntz"))


def micros(column: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


def from_micros(column: Column) -> Column:
    return F.timestamp_add("MICROSECOND", column, F.lit("1970-01-01").cast("timestamp_ntz"))


class _Bucket:
    """The database of one bucket, or of one input partition before the shuffle."""

    def __init__(self, first: pa.RecordBatch) -> None:
        import duckdb

        self.con = duckdb.connect(":memory:", config={"threads": 1})
        self.run("SET preserve_insertion_order = false")
        self.carried = [c for c in first.schema.names if c not in ("id", "op", "us", "payload", "seq")]
        self.receipts = "received" in self.carried
        self.con.register("batch", pa.Table.from_batches([first]))
        types = {name: kind for name, kind, *_ in self.run("DESCRIBE batch")}
        more = "".join(f", {c} {types[c]}" for c in self.carried)
        self.run(f"CREATE TABLE changes (id VARCHAR, op VARCHAR, us BIGINT, payload VARCHAR, seq BIGINT{more}, PRIMARY KEY (id, op, us, payload))")
        self.run("CREATE TABLE newest (id VARCHAR PRIMARY KEY, us BIGINT)")
        self.run("CREATE TABLE base (id VARCHAR PRIMARY KEY, us BIGINT, added BIGINT)")
        self.run("CREATE TABLE fallen_at (id VARCHAR PRIMARY KEY, us BIGINT)")
        self.run("CREATE TABLE fallen (id VARCHAR, us BIGINT, payload VARCHAR, seq BIGINT, PRIMARY KEY (id, us, payload))")
        self.run("CREATE TABLE arrived (id VARCHAR PRIMARY KEY, us BIGINT, seq BIGINT, received BIGINT)")
        self.bytes = 0

    def run(self, statement: str) -> list[tuple]:
        return self.con.execute(statement).fetchall()

    def upsert(self, batch: pa.RecordBatch) -> None:
        self.con.register("batch", pa.Table.from_batches([batch]))
        self.bytes += batch.nbytes
        old = "min(received)" if self.receipts else "NULL"
        self.run(f"INSERT INTO base SELECT id, max(us), {old} FROM batch WHERE op = '{BASE}' GROUP BY id ON CONFLICT (id) DO UPDATE SET us = greatest(base.us, excluded.us), added = least(base.added, excluded.added)")
        self.run(f"INSERT INTO newest SELECT id, max(us) FROM batch WHERE op IN ('{LIVE}', '{DELETED}') GROUP BY id ON CONFLICT (id) DO UPDATE SET us = excluded.us WHERE excluded.us > newest.us")
        names = "".join(f", {c}" for c in self.carried)
        values = "".join(f", min(struct_pack(s := b.seq, r := b.received)).r" if c == "received" else f", any_value(b.{c})" for c in self.carried)
        moved = ", received = excluded.received" if self.receipts else ""
        self.run(
            f"INSERT INTO changes (id, op, us, payload, seq{names}) SELECT b.id, b.op, b.us, b.payload, min(b.seq){values} FROM batch b JOIN newest n ON b.id = n.id AND b.us = n.us "
            f"WHERE b.op IN ('{LIVE}', '{DELETED}') GROUP BY b.id, b.op, b.us, b.payload ON CONFLICT (id, op, us, payload) DO UPDATE SET seq = excluded.seq{moved} WHERE excluded.seq < changes.seq"
        )
        if self.receipts:
            self.run(f"INSERT INTO fallen_at SELECT id, max(us) FROM batch WHERE op IN ('{DELETED}', '{FALLEN}') GROUP BY id ON CONFLICT (id) DO UPDATE SET us = excluded.us WHERE excluded.us > fallen_at.us")
            self.run(
                f"INSERT INTO fallen SELECT b.id, b.us, b.payload, min(b.seq) FROM batch b JOIN fallen_at f ON b.id = f.id AND b.us = f.us WHERE b.op IN ('{DELETED}', '{FALLEN}') GROUP BY b.id, b.us, b.payload "
                "ON CONFLICT (id, us, payload) DO UPDATE SET seq = excluded.seq WHERE excluded.seq < fallen.seq"
            )
            self.run(
                f"INSERT INTO arrived SELECT id, x.us, x.seq, x.received FROM (SELECT id, min(struct_pack(us := us, seq := seq, received := received)) AS x FROM batch WHERE op IN ('{LIVE}', '{ARRIVED}') GROUP BY id) "
                "ON CONFLICT (id) DO UPDATE SET us = excluded.us, seq = excluded.seq, received = excluded.received WHERE (excluded.us, excluded.seq) < (arrived.us, arrived.seq)"
            )
        changes, newest = self.run("SELECT (SELECT count(*) FROM changes), (SELECT count(*) FROM newest)")[0]
        if changes > 2 * newest + 10_000:  # what newer changes have beaten
            self.run("DELETE FROM changes USING newest WHERE changes.id = newest.id AND changes.us < newest.us")

    def full(self) -> bool:
        return self.bytes > COMBINER_BYTES or self.run("SELECT count(*) FROM newest")[0][0] > COMBINER_IDS

    def _newest(self) -> str:
        return "SELECT c.* FROM changes c JOIN newest n ON c.id = n.id AND c.us = n.us"

    def combined(self) -> Iterator[pa.RecordBatch]:
        """What the bucket of an id needs to know of this partition."""
        query = self._newest()
        if self.receipts:
            rest = "".join(f", NULL AS {c}" for c in self.carried if c != "received")
            query += f" UNION ALL BY NAME SELECT f.id, '{FALLEN}' AS op, f.us, f.payload, f.seq, NULL AS received{rest} FROM fallen f JOIN fallen_at a ON f.id = a.id AND f.us = a.us JOIN newest n ON n.id = f.id AND n.us > f.us"
            query += f" UNION ALL BY NAME SELECT id, '{ARRIVED}' AS op, us, '' AS payload, seq, received{rest} FROM arrived"
        return self.out(query)

    def settled(self) -> Iterator[pa.RecordBatch]:
        """The last effective change of each id; of its history, where receipts are kept,
        what ``added`` follows from."""
        effective = f"NOT EXISTS (FROM base b WHERE b.id = w.id AND b.us > {EARLIEST} AND b.us >= w.us)"
        winners = f"SELECT * FROM ({self._newest()}) w WHERE {effective} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, op, payload) = 1"
        if not self.receipts:
            return self.out(winners)
        fallen = f"SELECT w.id, w.us, max(w.seq) AS seq FROM fallen w JOIN fallen_at a ON w.id = a.id AND w.us = a.us WHERE {effective} GROUP BY w.id, w.us"
        return self.out(
            f"SELECT v.*, b.id IS NOT NULL AS known, b.added AS old_added, f.us AS fallen_us, f.seq AS fallen_seq, a.received AS first_received "
            f"FROM ({winners}) v LEFT JOIN base b ON b.id = v.id LEFT JOIN ({fallen}) f ON f.id = v.id LEFT JOIN arrived a ON a.id = v.id"
        )

    def out(self, query: str) -> Iterator[pa.RecordBatch]:
        yield from self.con.sql(query).to_arrow_table().to_batches(max_chunksize=10_000)
        self.con.close()


def _typed(batches: Iterator[pa.RecordBatch], schema: pa.Schema | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if schema is None:
            yield batch
        else:
            yield from pa.Table.from_batches([batch]).select(schema.names).cast(schema).to_batches()


def _combine(batches: Iterator[pa.RecordBatch], schema: pa.Schema | None = None) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: of every id the newest changes of this partition."""
    bucket = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = bucket or _Bucket(batch)
        bucket.upsert(batch)
        if bucket.full():
            yield from _typed(bucket.combined(), schema)
            bucket = None
    if bucket:
        yield from _typed(bucket.combined(), schema)


def _settle(batches: Iterator[pa.RecordBatch], schema: pa.Schema | None = None) -> Iterator[pa.RecordBatch]:
    """After the shuffle: the last effective change of every id of the bucket."""
    bucket = None
    for batch in batches:
        if batch.num_rows:
            bucket = bucket or _Bucket(batch)
            bucket.upsert(batch)
    if bucket:
        yield from _typed(bucket.settled(), schema)


def _records(feed: DataFrame, payload: tuple[str, ...], content: tuple[str, ...] = (), receipts: bool = False) -> DataFrame:
    """The feed as rows of a bucket."""
    fingerprint = F.md5(F.to_json(F.struct(*[F.col(c) for c in payload]))) if payload else F.lit("")
    received = [micros(F.col("received_at")).alias("received")] if receipts else []
    return feed.select(
        canonical_id("id").alias("id"),
        F.col("op"),
        F.coalesce(micros(F.col("changed_at")), F.lit(EARLIEST)).alias("us"),
        F.coalesce(fingerprint, F.lit("")).alias("payload"),
        F.coalesce(F.col("seq"), F.lit(EARLIEST)).cast("long").alias("seq"),
        *received,
        *[F.col(c) for c in content],
    ).filter(F.col("id").isNotNull() & F.col("op").isin(LIVE, DELETED))


def _winners(feed: DataFrame, snapshot: DataFrame | None, payload: tuple[str, ...], content: tuple[str, ...] = (), receipts: bool = False) -> DataFrame:
    """The last effective change of every id with what it carries: one combining pass
    before the shuffle and one settling pass after it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    records = _records(feed, payload, content, receipts)
    carried = [f for f in records.schema.fields if f.name in content]
    sent = T.StructType([*_KEY, *([_RECEIVED] if receipts else []), *carried])
    kept = T.StructType([*sent.fields, *(_HISTORY if receipts else [])])
    sent_arrow, kept_arrow = to_arrow_schema(sent), to_arrow_schema(kept)
    rows = records.mapInArrow(lambda batches: _combine(batches, sent_arrow), sent)
    if snapshot is not None:
        added = [micros(F.col("added")).alias("received")] if receipts and "added" in snapshot.columns else []
        base = snapshot.select(F.col("id"), F.lit(BASE).alias("op"), F.coalesce(instant("date"), F.lit(EARLIEST)).alias("us"), F.lit("").alias("payload"), F.lit(0).cast("long").alias("seq"), *added).filter(F.col("id").isNotNull())
        if not receipts:  # a base without a readable date would beat nothing
            base = base.filter(F.col("us") > EARLIEST)
        rows = rows.unionByName(base, allowMissingColumns=True)
    return rows.repartition("id").mapInArrow(lambda batches: _settle(batches, kept_arrow), kept)


def last_changes(feed: DataFrame, snapshot: DataFrame | None = None, payload: tuple[str, ...] = PAYLOAD) -> DataFrame:
    """(id, op, seq): the last effective change of every id, tombstones included.

    Changes apply in order of ``changed_at``, then ``seq``; records equal in id, op,
    time and payload are one change with the smallest ``seq`` of theirs.  A change is
    effective if the snapshot has no such id, or its ``date`` is empty or unreadable, or
    the change is later than it.  Records whose id or op is null or blank are skipped;
    a null time sorts before all others, a null ``seq`` likewise; null payload fields
    compare equal.  Repeated snapshot rows count with their latest date.  An empty feed
    gives no rows, an empty snapshot lets every change take effect.  Columns beyond
    those named are not read.
    """
    return _winners(feed, snapshot, payload).select("id", "op", "seq")


def paper_fields(record: DataFrame) -> DataFrame:
    """Feed records in the shape of the snapshot: creators joined, the longest
    description, the first subject and date, the first web address; '' for what is
    missing, and the year from the date, else from the id."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    descriptions = F.filter("descriptions", lambda x: x.isNotNull())
    longest = F.array_max(F.transform(descriptions, lambda x, i: F.struct(F.octet_length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    date = blank(F.get(F.filter("dates", lambda x: x.isNotNull()), F.lit(0)))
    head = F.regexp_extract(date, r"^(\d{4})", 1)
    year = F.coalesce(F.when(head != "", head).try_cast("int"), F.regexp_extract("id", r"^(\d{4})", 1).try_cast("int"), F.lit(0))
    authors = blank(F.array_join(F.filter("creators", lambda x: F.trim(x) != ""), "; "))
    used = ("id", *PAYLOAD)
    return record.select(
        "id",
        blank(F.trim("title")).alias("title"),
        authors.alias("authors"),
        fold_name(authors).alias("authors_fold"),
        blank(longest).alias("abstract"),
        blank(F.get(F.filter("subjects", lambda x: x.isNotNull()), F.lit(0))).alias("category"),
        blank(F.col("rights")).alias("rights"),
        blank(F.get(F.filter("identifiers", lambda x: x.startswith("http")), F.lit(0))).alias("url"),
        date.alias("date"),
        year.alias("year"),
        *[F.col(c) for c in record.columns if c not in used],
    )


def _arrived_again(feed: DataFrame, fallen: DataFrame, payload: tuple[str, ...]) -> DataFrame:
    """(id, again): when the first live change after an id's last deletion was received.
    ``fallen`` has (id, fallen_us, fallen_seq); an id's records are spread by a salt."""
    salted = fallen.select("id", "fallen_us", "fallen_seq", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    records = _records(feed, payload, receipts=True).filter(F.col("op") == LIVE).withColumn("salt", F.pmod(F.xxhash64("us", "seq"), F.lit(SALTS)).cast("int"))
    later = records.join(salted, ["id", "salt"]).filter(F.col("us") >= F.col("fallen_us"))
    changes = later.groupBy("id", "us", "payload", "fallen_us", "fallen_seq").agg(F.min(F.struct("seq", "received")).alias("x")).select("id", "us", "x.*", "fallen_us", "fallen_seq")
    after = changes.filter((F.col("us") > F.col("fallen_us")) | (F.col("seq") > F.col("fallen_seq")))
    return after.groupBy("id").agg(F.min_by("received", F.struct("us", "seq")).alias("again"))


def apply_feed(snapshot: DataFrame, feed: DataFrame) -> DataFrame:
    """The current table: the snapshot with every id's last effective change applied.

    Deleted ids are absent.  ``authors_fold`` of a changed row is its byline folded.
    ``added`` stays what the snapshot has (the earliest of repeated rows) while the id was
    never deleted; otherwise, and for new ids, it is when the first live change after the
    last deletion was received.  Other snapshot columns without a counterpart in the feed
    become null in changed rows.  Defined for the same dirty input as
    :func:`last_changes`; a change without ``seq`` or ``changed_at`` that wins is applied
    like any other.
    """
    last = written(_winners(feed, snapshot, PAYLOAD, PAYLOAD, receipts=True), "winners")
    live = last.filter(F.col("op") == LIVE)
    fallen = written(live.filter(F.col("fallen_us").isNotNull()).select("id", "fallen_us", "fallen_seq"), "fallen")
    fields = paper_fields(live).join(_arrived_again(feed, fallen, PAYLOAD), "id", "left")
    added = F.when(F.col("fallen_us").isNotNull(), F.col("again")).when(F.col("known"), F.col("old_added")).otherwise(F.col("first_received"))
    fields = fields.withColumn("added", from_micros(added))
    changed = fields.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in snapshot.schema.fields if f.name in fields.columns])
    untouched = snapshot.join(last.select(F.col("id").alias("_id")), snapshot["id"] == F.col("_id"), "left_anti")
    return untouched.unionByName(changed, allowMissingColumns=True).select(*snapshot.columns)


# -- publishing ------------------------------------------------------------------------


def _path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def _files(spark: SparkSession, folder: str):
    return _path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration())


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    """Which version each part of a published table is of; None before the first."""
    if not published(spark, folder):
        return None
    return json.loads(spark.read.text(f"{folder}/CURRENT", wholetext=True).first()[0])


def published(spark: SparkSession, folder: str) -> bool:
    return _files(spark, folder).exists(_path(spark, f"{folder}/CURRENT"))


def publish(df: DataFrame, folder: str, replaced: Collection[int] | None = None) -> str:
    """Writes ``df`` as a new version below ``folder`` and makes it current at once.

    With ``replaced``, ``df`` has the column ``bucket`` and holds those buckets only; the
    others stay as they are.  The version is complete before the pointer to it is swapped
    by an atomic rename, so a reader sees the old table or the new one; a run that is lost
    leaves the old one.  Versions that neither the new table nor the one before it needs
    are deleted.
    """
    spark = df.sparkSession
    version, old = f"v-{uuid.uuid4().hex}", _manifest(spark, folder)
    files, conf = _files(spark, folder), spark._jsc.hadoopConfiguration()
    if replaced is None:
        df.write.parquet(f"{folder}/{version}")
        parts, schema = {"": version}, df.schema
    else:
        df.write.partitionBy(BUCKET).parquet(f"{folder}/{version}")
        there = {str(p.getPath().getName()) for p in files.listStatus(_path(spark, f"{folder}/{version}"))}
        kept = {b: v for b, v in (old["parts"] if old else {}).items() if b and int(b) not in set(replaced)}
        parts = kept | {str(b): version for b in replaced if f"{BUCKET}={b}" in there}
        schema = T.StructType([f for f in df.schema.fields if f.name != BUCKET])
    draft, pointer = _path(spark, f"{folder}/.current-{version}"), _path(spark, f"{folder}/CURRENT")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps({"parts": parts, "schema": schema.json()}).encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf).rename(draft, pointer, options)
    needed = {*parts.values(), *(old["parts"].values() if old else ())}
    for status in files.listStatus(_path(spark, folder)):
        name = str(status.getPath().getName())
        if name.startswith("v-") and name not in needed:
            files.delete(status.getPath(), True)
    return version


def current(spark: SparkSession, folder: str, buckets: Collection[int] | None = None) -> DataFrame:
    """The version of a published table that is current now, or some of its buckets."""
    manifest = _manifest(spark, folder)
    if manifest is None:
        raise ValueError(f"nothing has been published in {folder}")
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    wanted = None if buckets is None else {str(b) for b in buckets}
    paths = [f"{folder}/{v}" + (f"/{BUCKET}={b}" if b else "") for b, v in manifest["parts"].items() if not b or wanted is None or b in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


__all__ = ["BUCKET", "apply_feed", "bucket_of", "canonical_id", "current", "instant", "last_changes", "micros", "paper_fields", "publish", "published"]
