"""The change feed and the arrivals as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import cdc

#: Columns of the state table: the winner of each id, tombstones included.
STATE = ("id", "op", "changed_at", "seq", "title", "rights", "creators", "descriptions", "subjects", "dates", "identifiers")
#: A column more: all changes of the winner's instant.
TIES = "ties"
#: Parts of the state that are rewritten apart from each other.
BUCKETS = 64


def merge_state(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The state after a batch: per id the change that is last by time, then sequence.

    Records equal in op, time and payload are one change with the smallest sequence of
    theirs, whatever batch they come in.  A later delivery can lower the sequence of the
    winner or of a change it beat, so all changes of the newest instant stay in ``ties``.
    Tombstones stay, so a late older record cannot undo a deletion."""
    change = [c for c in STATE if c not in ("id", "changed_at", "seq")]
    rows = ["id", "changed_at", "seq", *change]
    every = batch.withColumn("id", cdc.canonical_id("id")).filter(F.col("id").isNotNull()).select(*rows)
    if state is not None:
        # a state from before there were ties holds one change of each id
        old = state.select("id", "changed_at", F.inline(TIES)) if TIES in state.columns else state
        every = every.unionByName(old.select(*rows))
    content = F.md5(F.to_json(F.struct(*[F.col(c) for c in change if c != "op"])))
    changes = every.groupBy("id", "changed_at", "op", content.alias("content")).agg(F.min("seq").alias("seq"), F.any_value(F.struct(*change)).alias("x"))
    instants = changes.groupBy("id", "changed_at").agg(F.sort_array(F.collect_list(F.struct("seq", "x.*"))).alias(TIES))
    newest = instants.groupBy("id").agg(F.max_by(F.struct("changed_at", TIES), F.struct("changed_at")).alias("x")).select("id", "x.*")
    return newest.withColumn("last", F.element_at(TIES, -1)).select("id", "changed_at", TIES, "last.*").select(*STATE, TIES)


def first_seen(feed: DataFrame) -> DataFrame:
    """(id, added) of the ids that are live in the end: when the first record after the
    last deletion was received."""
    rows = feed.withColumn("id", cdc.canonical_id("id")).filter(F.col("id").isNotNull())
    order = F.struct("changed_at", "seq")
    dead = rows.filter(F.col("op") == cdc.DELETED).groupBy("id").agg(F.max(order).alias("dead"))
    alive = rows.filter(F.col("op") == cdc.LIVE).join(dead, "id", "left").filter(F.col("dead").isNull() | (order > F.col("dead")))
    return alive.groupBy("id").agg(F.min_by("received_at", order).alias("added"))


def run_feed(spark: SparkSession, source: str, schema, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Applies the files that appear in ``source`` to the published state in ``table``.

    Each micro-batch reads and writes the buckets its ids fall into, and makes them
    current together by one rename; a batch that is run again after a failure gives the
    same state, since applying a record twice changes nothing.  ``buckets`` must stay
    what it was when the table was begun."""

    def apply(batch: DataFrame, _: int) -> None:
        session, bucket = batch.sparkSession, cdc.bucket_of("id", buckets).alias(cdc.BUCKET)
        ids = batch.select(cdc.canonical_id("id").alias("id")).filter("id IS NOT NULL")
        touched = [r[0] for r in ids.select(bucket).distinct().collect()]  # at most one row per bucket
        if not touched:
            return
        state = cdc.current(session, table, touched) if cdc.published(session, table) else None
        cdc.publish(merge_state(state, batch).withColumn(cdc.BUCKET, bucket), table, touched)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(spark: SparkSession, source: str, schema, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Changes per window of the time of receipt and kind, as a stream with a watermark."""
    stream = spark.readStream.schema(schema).parquet(source)
    timed = stream.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op", "n")
