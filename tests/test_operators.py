from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators import byline, feed, link, query, suggest, watch
from lectern.operators.watch import Watch, parse_watch

PAPERS = "id string, title string, authors string, abstract string, category string, rights string, url string, date string, year int, added timestamp_ntz"
T0 = datetime(2024, 1, 1)


def paper(id_, title="", authors="", abstract="", category="", date="", year=0, added=None):
    return (id_, title, authors, abstract, category, "", "", date, year, added)


# -- standing queries ------------------------------------------------------------------


@given(st.builds(lambda t, a, c, s: (t, a, c, s), st.sampled_from(["", "hash", '"two words"', "a OR b"]), st.sampled_from([None, "Ana Dorn", "Li", " "]), st.sampled_from([None, "key things", "x"]), st.sampled_from(["all", "title"])))
@settings(max_examples=60, deadline=None)
def test_labels_round_trip(parts):
    try:
        w = Watch.make(*parts)
    except ValueError:
        return
    assert watch.round_trips(w) and parse_watch(w.label()) == w


def test_watch_lines():
    w = parse_watch('lattice -a "Dorn, Ana" -c keys -t')
    assert w == Watch("lattice", "Ana Dorn", "keys", "title")
    assert w.label() == 'lattice --author "Ana Dorn" --category keys --title' and w.label() != w.describe()
    assert parse_watch("") is None and parse_watch("--author") is None
    assert watch.add([w], w) == [w] and watch.remove([w, Watch("x")], 1) == [Watch("x")] and watch.remove([w]) == []
    with pytest.raises(ValueError):
        watch.remove([w], 2)
    with pytest.raises(ValueError):
        Watch.make(" ", "", None)


def test_watch_matching_and_sync(spark):
    rows = [paper("1", "Hash functions", "Ana Dorn", category="keys"), paper("2", "Lattices", "Bo Fox"), paper("3", "hash", "Ana Dorn")]
    p = query.searchable(spark.createDataFrame(rows, PAPERS))
    ws = [Watch("hash"), Watch("", "ana dorn", "keys"), Watch("(((")]
    hits = watch.match_all(p, ws)
    got = {(r.id, r.label) for r in hits.collect()}
    assert got == {("1", "hash"), ("3", "hash"), ("1", ws[1].label())}
    assert {r.label: r.n for r in watch.counts(hits).collect()} == {"hash": 2, ws[1].label(): 1}
    assert [(r.number, r.n) for r in watch.listing(hits, ws).orderBy("number").collect()] == [(1, 2), (2, 1), (3, 0)]
    now = watch.sync(hits, p, [ws[0], Watch("lattice")], [w.label() for w in ws])
    assert {(r.id, r.label) for r in now.collect()} == {("1", "hash"), ("3", "hash"), ("2", "lattice")}
    changed = query.searchable(spark.createDataFrame([paper("1", "Other"), paper("9", "hashes")], PAPERS))
    again = watch.sync(hits, p, ws[:1], ["hash"], changed)
    assert {(r.id, r.label) for r in again.collect()} == {("3", "hash"), ("9", "hash")}
    assert watch.match_all(p, []).count() == 0
    assert {r.id for r in query.matching(p, query.Query(only_watched=True), hits).collect()} == {"1", "3"}


# -- feed ------------------------------------------------------------------------------


def test_feed(spark):
    rows = [paper(str(i), date=f"2024-01-{i + 1:02d}", added=T0 + timedelta(days=i)) for i in range(20)] + [paper("x")]
    p = spark.createDataFrame(rows, PAPERS)
    ids = lambda f: [r.id for r in f.rows.select("id").collect()]
    now = T0 + timedelta(days=20)
    first = feed.feed(p, feed.FeedState(), now, floor=3)
    assert ids(first) == [str(i) for i in range(19, 13, -1)] and first.label.startswith("6 new") and first.state == feed.FeedState(now, now - timedelta(days=7))
    second = feed.feed(p, first.state, now + timedelta(hours=1), floor=3)
    assert ids(second) == ids(first) and second.label.startswith("last batch, from 2024-01-20") and second.state.new_batch_from == first.state.new_batch_from
    topped = feed.feed(p, feed.FeedState(T0 + timedelta(days=18)), now, floor=5)
    assert ids(topped) == ["19", "18", "17", "16", "15"] and topped.label.startswith("1 new")
    nothing = feed.feed(p, feed.FeedState(now), now, limit=2)
    assert ids(nothing) == ["19", "18"] and nothing.label.startswith("nothing new")
    assert feed.feed(p.limit(0), feed.FeedState(), now).rows.count() == 0


def test_window_and_staleness(spark):
    p = spark.createDataFrame([paper("1", date="2024-03-05T01:02:03Z"), paper("2", date="")], PAPERS)
    start = lambda t: feed.incremental_from(p, t).first().start
    assert start(datetime(2024, 4, 1)) == datetime(2024, 3, 3, 1, 2, 3) and start(datetime(2024, 3, 1)) == datetime(2024, 2, 28) and start(None) is None
    now = datetime(2024, 1, 2, 12)
    assert feed.stale(None, None, now) and not feed.stale(now, None, now) and not feed.stale(None, now, now)
    assert feed.stale(now - timedelta(hours=1), now - timedelta(hours=25), now)


# -- bylines, suggestions --------------------------------------------------------------


def aliases(spark):
    return spark.createDataFrame([("Ana Dorn", "a dorn"), ("Ana Dorn", "anna dorn"), ("Jean-Luc Fox", None), ("Bo Fox", "b fox"), ("Ben Fox", "b fox")], "representative string, stray string")


def test_canonical_bylines(spark):
    rows = [("1", " A. Dorn ;Jean Luc  Fox; Cy Gray;"), ("2", "B. Fox; Anna Dorn"), ("3", ""), ("4", "Ana Dorn; Jean-Luc Fox")]
    p = spark.createDataFrame(rows, "id string, authors string")
    once = {r.id: r.canonical for r in byline.canonical_bylines(p, aliases(spark)).collect()}
    assert once == {"1": "Ana Dorn; Jean-Luc Fox; Cy Gray", "2": "B. Fox; Ana Dorn", "3": "", "4": "Ana Dorn; Jean-Luc Fox"}
    twice = byline.canonical_bylines(spark.createDataFrame(list(once.items()), "id string, authors string"), aliases(spark))
    assert {r.id: r.canonical for r in twice.collect()} == once
    assert {r.id for r in byline.changed_bylines(p, aliases(spark)).collect()} == {"1", "2"}
    mark = lambda a: byline.alias_fingerprint(a).first().fingerprint
    assert mark(aliases(spark)) == mark(aliases(spark).orderBy("stray")) != mark(aliases(spark).limit(2))


def test_suggestions(spark):
    rows = [paper("1", authors="José Lima; Ana Dorn", category="Keys"), paper("2", authors="Jose Lima"), paper("3", authors="Lima Bar", category="keys and locks"), paper("4", authors="Ana Dorn; Ana Dorn")]
    p = spark.createDataFrame(rows, PAPERS)
    assert [(r.value, r.papers) for r in suggest.suggest_authors(p, "lima").collect()] == [("Lima, José", 2), ("Lima Bar", 1), ("José Lima", 2), ("Bar, Lima", 1)]
    assert [(r.value, r.papers) for r in suggest.suggest_authors(p, "Dorn", 1).collect()] == [("Dorn, Ana", 2)]
    assert suggest.suggest_authors(p, "l").count() == 0
    assert [r.category for r in suggest.suggest_categories(p, "KEY").collect()] == ["Keys", "keys and locks"]


# -- links -----------------------------------------------------------------------------

ENTRIES = "key string, title string, author string, year string, howpublished string, raw string, title2 string"


def entry(key, title, author="Dorn, Ana", year="2020", how="", raw="year = {2020}"):
    return (key, title, author, year, how, raw, "x")


def test_links(spark):
    p = spark.createDataFrame([paper("2020/1", "On {Keys}!", "Ana Dorn; Bo Fox", year=2020), paper("2020/2", "On Keys", "Zed Zorn", year=2020), paper("2020/3", "", "Ana Dorn", year=2020)], PAPERS)
    rows = [entry("b", "on keys", year="2021"), entry("a", "On Keys", year="2019"), entry("c", "On keys", "Nobody, N."), entry("d", ""), entry("e", "On keys", year=None), entry("E:1", "On keys", how="Report 2020/2"), entry("E:0", "x", how="Report 2020/2"), entry(None, "On keys"), entry("F", "x", how="Report 1999/9")]
    e = spark.createDataFrame(rows, ENTRIES)
    # 2020 itself stands in the archive's entry, which names the other paper
    assert [(r.paper_id, r.key) for r in link.link_published(p, e.filter("key not like 'E%'")).collect()] == [("2020/1", "a")]
    links = link.link_published(p, e).unionByName(link.link_preprints(p, e))
    best = {r.paper_id: (r.key, r.is_published) for r in link.best_links(links).collect()}
    assert best == {"2020/1": ("E:1", True), "2020/2": ("E:1", False)}
    bare = spark.createDataFrame([entry("z", "on keys", raw="year = 2020"), entry("y", "on keys", year="2000")], ENTRIES)
    assert link.link_published(p, bare).first().key == "z" and link.link_published(p, bare, compat=True).first().key == "y"
    assert link.link_published(p, bare.filter("key = 'z'").unionByName(spark.createDataFrame([entry("a", "on keys", year="1990", raw="year = 1990")], ENTRIES)), compat=True).first().key == "a"
    cover = link.coverage(p, links).first()
    assert (cover.papers, cover.linked, cover.published, cover.linked_percent) == (3, 2, 1, 66.7)
    assert {r.id: r.key for r in link.with_links(p, links).collect()} == {"2020/1": "E:1", "2020/2": "E:1", "2020/3": None}
    twice = spark.createDataFrame([("p", "preprint", "k1", 1), ("p", "preprint", "k2", 2), ("p", "published", "k0", 0)], "paper_id string, kind string, key string, n int")
    assert {(r.kind, r.key) for r in link.upsert_links(twice, "n").collect()} == {("preprint", "k2"), ("published", "k0")}
    assert link.link_published(p.limit(0), e).count() == 0 and query.status(p, links, {"last_harvest": "x"}).first().links == 2


def test_lookups(spark):
    p = spark.createDataFrame([paper("1", "A", category="k", date="2024-01-01"), paper("2", "B", category="k", date="2024-01-01"), paper("3", "C", category="a")], PAPERS)
    assert query.get(p, "2").first().title == "B" and query.get(p, "9").count() == 0
    assert query.titles(p, ["1", "9"]).count() == 1 and query.titles(p, []).count() == 0
    assert [(r.category, r.n) for r in query.categories(p).collect()] == [("k", 2), ("a", 1)]
    assert query.newest(p).first().id == "2"
    files = spark.createDataFrame([("1", "x"), ("9", "y")], "id string, name_title string")
    assert {r.title for r in query.titled(files, p).collect()} == {"A", "y"}


def test_canonical_bylines_by_map_and_by_join(spark, monkeypatch):
    from lectern.operators import byline

    papers = spark.createDataFrame([("1", "Ana  Dorn; b fox ;; Zed Zorn"), ("1", "Ana  Dorn; b fox ;; Zed Zorn"), ("2", "Ana Dorn Bo Fox; X Y"), ("3", ""), ("4", None), ("5", "Anadorn")], "id string, authors string")
    aliases = spark.createDataFrame([("Ana Dorn", None), ("Bo Fox", "b fox"), ("Bo Fox", "robert fox")], "representative string, stray string")
    merged = {"ana dorn bo fox": "Anadorn; robert fox"}
    want = sorted([("1", "Ana Dorn; Bo Fox; Zed Zorn"), ("1", "Ana Dorn; Bo Fox; Zed Zorn"), ("2", "Ana Dorn; Bo Fox; X Y"), ("3", ""), ("4", None), ("5", "Ana Dorn")], key=str)
    run = lambda p, m=merged: sorted(((r.id, r.canonical) for r in byline.canonical_bylines(p, aliases, merged=m).collect()), key=str)
    assert run(papers) == want
    again = spark.createDataFrame(run(papers), "id string, authors string")
    assert run(again, None) == want
    assert byline.canonical_bylines(papers.limit(0), aliases.limit(0)).count() == 0
    monkeypatch.setattr(byline.AliasTable, "of", classmethod(lambda cls, aliases, most=0: None))
    assert run(papers) == want


def test_needles_and_person_forms(spark):
    from lectern.functions.names import author_match
    from lectern.operators import byline

    aliases = spark.createDataFrame([("Yara Kolm", "yara tauber kolm"), ("Yara Kolm", "y kolmova"), ("Bo Fox", None)], "representative string, stray string")
    table = byline.AliasTable.of(aliases)
    assert byline.AliasTable.of(aliases, most=2) is None
    assert table.needle("Yara Tauber Kolm") == "Yara Kolm" and table.needle("kolm") == "kolm" and table.person("Kolmova, Y.") == "Yara Kolm" and table.person(" Zorn , Zed") == "Zed Zorn"
    papers = spark.createDataFrame([("1", "Yara Kolm; Zed Zorn")], "id string, authors string")
    assert papers.filter(author_match("authors", table.needle("Yara Tauber Kolm"))).count() == 1 and papers.filter(author_match("authors", "Yara Tauber Kolm")).count() == 0
    names = spark.createDataFrame([(1, "Yara Tauber Kolm"), (2, "Kolmova, Y."), (3, "a, b, c"), (4, " BoFox "), (5, None)], "name_id int, name string")
    assert {r.name_id: r.needle for r in byline.canonical_needles(names, aliases).collect()} == {1: "yara kolm", 2: "kolmova y", 3: "a b c", 4: "bo fox", 5: None}
    assert {r.name_id: r.person for r in byline.canonical_persons(names, aliases).collect()} == {1: "Yara Kolm", 2: "Yara Kolm", 3: "a, b, c", 4: "Bo Fox", 5: None}
