"""The change feed against a plain Python model."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from lectern.operators import cdc
from lectern.streaming import feed_stream

FEED = "seq long, op string, id string, changed_at timestamp_ntz, received_at timestamp_ntz, title string, rights string, creators array<string>, descriptions array<string>, subjects array<string>, dates array<string>, identifiers array<string>, extra string"
PAPERS = "id string, title string, authors string, authors_fold string, abstract string, category string, rights string, url string, date string, year int, added timestamp_ntz"
T0 = datetime(2024, 1, 1)


def record(seq, op, id_, hours, title="t", **more):
    live = op == "live"
    at = None if hours is None else T0 + timedelta(hours=hours)
    values = {"rights": "r", "creators": ["A B"], "descriptions": ["d"], "subjects": ["s"], "dates": ["2024-01-01"], "identifiers": ["urn:x", "https://a/1"]} | more
    return (seq, op, id_, at, T0 + timedelta(hours=seq or 0), title if live else None, *[v if live else None for v in values.values()], "x")


def paper(id_, date=""):
    return (id_, "old", "A", "a", "", "c", "", "", date, 2000, T0)


def expected(papers, records):
    dates = {}
    for p in papers:
        dates.setdefault(p[0], p[8])
    changes = {}
    for r in records:
        id_ = r[2].split(":")[-1].strip() if r[2] else ""
        if not id_ or r[1] not in ("live", "deleted"):
            continue
        content = repr(r[5:12])
        key = (id_, r[1], r[3], content)
        changes[key] = min(changes.get(key, r[0]), r[0])
    out = {}
    for (id_, op, at, _), seq in changes.items():
        date = dates.get(id_, "")
        threshold = datetime.fromisoformat(date.removesuffix("Z")) if date else None
        if threshold is not None and at <= threshold:
            continue
        if id_ not in out or (at, seq) > out[id_][:2]:
            out[id_] = (at, seq, op)
    return {k: (v[2], v[1]) for k, v in out.items()}


def winners(spark, papers, records):
    rows = cdc.last_changes(spark.createDataFrame(records, FEED).repartition(5), spark.createDataFrame(papers, PAPERS)).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: (r.op, r.seq) for r in rows}


def test_random_feeds(spark):
    rng = random.Random(5)
    for _ in range(3):
        papers = [paper(f"2020/{i}", rng.choice(["", "2024-01-02", "2024-01-03T04:00:00Z"])) for i in range(12)]
        records = []
        for seq in range(400):
            i = 0 if rng.random() < 0.35 else rng.randint(0, 20)  # one id holds a third
            id_ = rng.choice([f"2020/{i}", f" 2020/{i}\n", f"oai:x:2020/{i}", "", None])
            records.append(record(seq, rng.choice(["live", "live", "deleted", "odd"]), id_, rng.randint(0, 120), rng.choice("ab")))
        records += [(r[0] + 1000, *r[1:]) for r in records[:150]]  # delivered again
        records += records[:50]  # full duplicates
        rng.shuffle(records)
        assert winners(spark, papers, records) == expected(papers, records)


def test_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        records = [record(s, "live", f"2020/{s % 7}", (s * 37) % 101) for s in range(300)]
        assert winners(spark, [paper("2020/1", "2024-01-02")], records) == expected([paper("2020/1", "2024-01-02")], records)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_combiner_that_starts_afresh(spark, monkeypatch):
    monkeypatch.setattr(cdc, "COMBINER_IDS", 3)
    import pyarrow as pa

    batch = lambda a, b: pa.RecordBatch.from_pydict({"id": [f"i{k}" for k in range(a, b)], "op": ["live"] * (b - a), "us": [k for k in range(a, b)], "payload": [""] * (b - a), "seq": [1] * (b - a)})
    out = [r for x in cdc._combine(iter([batch(0, 5), batch(2, 9)])) for r in x.to_pylist()]
    assert {r["id"] for r in out} == {f"i{k}" for k in range(9)}


def test_nulls_ties_and_empty_tables(spark):
    records = [record(1, "live", "a/1", None), record(2, "deleted", "a/1", 5), record(4, "live", "a/1", 5), record(None, "live", "b/2", None), record(3, None, "c/3", 1)]
    assert winners(spark, [], records) == {"a/1": ("live", 4), "b/2": ("live", cdc.EARLIEST)}
    assert winners(spark, [paper("a/1")], []) == {}
    assert winners(spark, [paper("a/1", "no date"), paper(None)], records[:2]) == {"a/1": ("deleted", 2)}
    # a late older record does not undo a deletion; equal to the snapshot's time is not later
    late = [record(9, "live", "a/1", 1), record(2, "deleted", "a/1", 5)]
    assert winners(spark, [paper("a/1", "2024-01-01T05:00:00Z")], late) == {}


def test_apply_and_publish(spark, tmp_path):
    papers = spark.createDataFrame([paper("a/1"), paper("a/2"), paper("a/3", "2030-01-01")], PAPERS)
    long = ["short", "the longest one", None]
    feed = spark.createDataFrame([record(1, "live", "oai:a/1", 1, " new ", creators=["X Y", "", "Z"], descriptions=long, subjects=[], dates=[None, "2019-05-05"]), record(2, "deleted", "a/2", 1), record(3, "live", "a/3", 2), record(4, "live", "2021/9", 2, dates=[], identifiers=None)], FEED)
    out = {r.id: r for r in cdc.apply_feed(papers, feed).collect()}
    assert set(out) == {"a/1", "a/3", "2021/9"}
    new = out["a/1"]
    assert (new.title, new.authors, new.abstract, new.category, new.date, new.year, new.url, new.added) == ("new", "X Y; Z", "the longest one", "", "2019-05-05", 2019, "https://a/1", T0)
    assert out["a/3"].title == "old" and out["2021/9"].year == 2021 and out["2021/9"].url == "" and out["2021/9"].added == T0 + timedelta(hours=4)
    folder = f"file://{tmp_path}/t"
    first = cdc.publish(papers, folder)
    assert cdc.current(spark, folder).count() == 3
    assert cdc.publish(papers.limit(1), folder) != first and cdc.current(spark, folder).count() == 1


def test_what_a_changed_row_has(spark):
    """Folded byline, arrival, and winners without a sequence or a time."""
    papers = spark.createDataFrame([paper("a/1"), paper("a/2"), paper("a/3"), paper("a/4"), paper("a/4"), paper("a/5")], PAPERS)
    records = [
        record(None, "live", "a/1", 1, creators=["Zoé Übel"]),
        record(1, "deleted", "a/2", 1), record(2, "live", "a/2", 2), record(3, "live", "a/2", 3), record(9, "live", "a/2", 2),
        record(4, "live", "a/3", 5, "first"), record(5, "deleted", "a/3", 5), record(6, "live", "a/3", 5, "again"), record(7, "live", "a/3", 5, "first"),
        record(8, "live", "a/4", 2),
        record(10, "live", "b/1", None),
        record(11, "live", "b/2", 4), record(12, "live", "b/2", 3), record(13, "deleted", "b/2", 2),
    ]
    for order in (records, records[::-1]):
        got = cdc.apply_feed(papers, spark.createDataFrame(order, FEED).repartition(3)).collect()
        out = {r.id: r for r in got}
        assert len(got) == len(out) and set(out) == {"a/1", "a/2", "a/3", "a/4", "a/5", "b/1", "b/2"}
        assert (out["a/1"].authors, out["a/1"].authors_fold, out["a/1"].added) == ("Zoé Übel", "zo ubel", T0)
        assert out["a/2"].added == T0 + timedelta(hours=2)
        assert (out["a/3"].title, out["a/3"].added) == ("again", T0 + timedelta(hours=6))
        assert out["a/4"].added == T0 and out["a/5"].title == "old"
        assert out["b/1"].added == T0 + timedelta(hours=10) and out["b/2"].added == T0 + timedelta(hours=12)
    assert cdc.apply_feed(papers.limit(0), spark.createDataFrame([], FEED)).count() == 0


def test_publishing_some_buckets(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    rows = lambda pairs: spark.createDataFrame(pairs, "id string, n int, bucket int")
    read = lambda: sorted((r.id, r.n) for r in cdc.current(spark, folder).collect())
    cdc.publish(rows([("a", 1, 0), ("b", 1, 1), ("c", 1, 2)]), folder, [0, 1, 2])
    cdc.publish(rows([("b", 2, 1)]), folder, [1])
    assert read() == [("a", 1), ("b", 2), ("c", 1)]
    cdc.publish(rows([("d", 3, 1)]).limit(0), folder, [1, 2])
    assert read() == [("a", 1)] and cdc.current(spark, folder, [1]).count() == 0
    for n in range(3):
        cdc.publish(rows([("a", n, 0)]), folder, [0])
    assert len([p for p in tmp_path.joinpath("t").iterdir() if p.name.startswith("v-")]) == 2


def test_stream_equals_batch(spark, tmp_path):
    records = [record(s, "deleted" if s % 5 == 0 else "live", f"a/{s % 4}", (s * 13) % 29) for s in range(40)]
    df = spark.createDataFrame(records, FEED)
    for part in range(3):
        df.filter(f"seq % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = feed_stream.run_feed(spark, f"{tmp_path}/in", df.schema, f"file://{tmp_path}/state", f"{tmp_path}/check")
    query.awaitTermination(120)
    key = lambda d: sorted((r.id, r.op, r.seq) for r in d.select("id", "op", "seq").collect())
    assert key(cdc.current(spark, f"file://{tmp_path}/state")) == key(feed_stream.merge_state(None, df)) == key(cdc.last_changes(df))
    seen = {r.id: r.added for r in feed_stream.first_seen(df).collect()}
    assert set(seen) <= {f"a/{k}" for k in range(4)}


def test_state_at_equal_times(spark):
    records = [record(5, "live", "a/1", 1, "old"), record(7, "live", "oai:a/1", 1, "new"), record(9, "live", "a/1", 1, "old"), record(3, "live", "b/1", 2), record(4, "deleted", "b/1", 2), record(6, "live", "b/1", 2), record(8, "live", "c/1", 1, "x"), record(2, "live", "c/1", 1, "y"), record(1, "live", "c/1", 1, "x"), record(10, "deleted", "d/1", 4), record(11, "live", "d/1", 3), record(12, "live", "e/1", None)]
    want = {"a/1": ("live", 7, "new"), "b/1": ("deleted", 4, None), "c/1": ("live", 2, "y"), "d/1": ("deleted", 10, None), "e/1": ("live", 12, "t")}
    assert {k: v[:2] for k, v in want.items()} == {k: v for k, v in expected([], [r for r in records if r[3]]).items()} | {"e/1": ("live", 12)}
    get = lambda d: {r.id: (r.op, r.seq, r.title) for r in d.collect()}
    assert get(feed_stream.merge_state(None, spark.createDataFrame(records, FEED))) == want
    # batch by batch, in any order
    for seed in range(2):
        random.Random(seed).shuffle(records)
        state = None
        for k in range(0, len(records), 4):
            state = feed_stream.merge_state(state, spark.createDataFrame(records[k : k + 4], FEED))
        assert get(state) == want


def test_first_seen_restarts_after_deletion(spark):
    df = spark.createDataFrame([record(1, "live", "a/1", 1), record(2, "deleted", "a/1", 2), record(3, "live", "a/1", 3), record(4, "live", "a/1", 4), record(5, "live", "b/1", 1), record(6, "deleted", "b/1", 2)], FEED)
    assert {r.id: r.added for r in feed_stream.first_seen(df).collect()} == {"a/1": T0 + timedelta(hours=3)}


def test_arrivals_stream(spark, tmp_path):
    df = spark.createDataFrame([record(s, "live", "a/1", 1) for s in range(48)], FEED)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = feed_stream.arrivals(spark, f"{tmp_path}/in", df.schema).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("arrivals").groupBy().sum("n").first()[0] == 48
