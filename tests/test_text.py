"""Search against SQLite's own full-text index, with random queries."""

from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions.porter import stem
from lectern.functions.text import CLOSE, OPEN, analyse, mark_phrases, stems_of, tokens_of
from lectern.operators import fts, query
from lectern.operators.query import Query

WORDS = "lattice lattices signature signatures signing encrypt encryption encrypted proof proofs zero knowledge hash hashing geology Über naïve Ørsted co-op x²y".split()


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".", "-"]) for _ in range(rng.randint(0, k)))
    return [(str(i), text(6), text(3), text(30), text(2)) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def sqlite_ids(rows, expression, tokenizer):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE t USING fts5(title, authors_fold, abstract, category, tokenize='{tokenizer}')")
    db.executemany("INSERT INTO t(rowid, title, authors_fold, abstract, category) VALUES (?,?,?,?,?)", rows)
    return {str(r[0]) for r in db.execute("SELECT rowid FROM t WHERE t MATCH ?", [expression])}


def random_expression(rng, depth=0):
    word = lambda: rng.choice([w for w in WORDS if w.isalpha()])
    kind = rng.randint(0, 9 if depth < 2 else 4)
    if kind == 0:
        return word()
    if kind == 1:
        return word()[: rng.randint(2, 6)] + "*"
    if kind == 2:
        return f'"{word()} {word()}"' + rng.choice(["", "*"])
    if kind == 3:
        return "^" + word()
    if kind == 4:
        return f"NEAR({word()} {word()}, {rng.randint(0, 5)})"
    if kind == 5:
        return f"{word()} {word()}"
    if kind == 6:
        return rng.choice(["title", "abstract", "{title category}", "- title"]) + " : (" + random_expression(rng, 2) + ")"
    op = rng.choice(["AND", "OR", "NOT"])
    return f"({random_expression(rng, depth + 1)}) {op} ({random_expression(rng, depth + 1)})"


@pytest.mark.parametrize("stemmed", [False, True])
def test_random_queries_match_sqlite(spark, rows, stemmed):
    df = spark.createDataFrame(rows, "id string, title string, authors string, abstract string, category string")
    norm = analyse(df, {"title": "title_norm", "authors": "authors_norm", "abstract": "abstract_norm", "category": "category_norm"}, stemmed).cache()
    rng = random.Random(11)
    fixed = ["lattice NOT proof zero", "lattice NOT proof AND zero", "title : proof hash", "proof + zero", "zero * ", "lattice OR proof hash"]
    expressions = fixed + [random_expression(rng) for _ in range(60)]
    tests = [fts.predicate(fts.parse(e), "all", fts.Analysis(stemmed)).alias(f"q{k}") for k, e in enumerate(expressions)]
    got = norm.select("id", *tests).collect()
    for k, e in enumerate(expressions):
        # bylines also match folded terms here; the words of this corpus fold to themselves
        assert {r.id for r in got if r[f"q{k}"]} == sqlite_ids(rows, e, "porter unicode61" if stemmed else "unicode61"), e


def test_stemmer_pairs():
    pairs = "signatures signatur|signing sign|homomorphically homomorph|generalizations gener|ponies poni|ties ti|feed feed|agreed agre|hopping hop|filing file|sky sky|yes ye|geology geologi|geological geolog|possibly possibl|controll control|us us|eed e"
    for pair in pairs.split("|"):
        word, want = pair.split()
        assert stem(word) == want


def test_tokens():
    assert tokens_of("Naïve O'Brien—x² ﬁne Ørsted_ß") == ["naive", "o", "brien", "x²", "ﬁne", "ørsted", "ß"]
    assert stems_of("") == []


@pytest.mark.parametrize("bad", ["NOT a", "a AND", "()", "a AND (NOT b)", "no column : x", '"open', "a,b", "2026/12"])
def test_unreadable(bad):
    with pytest.raises(fts.QueryError):
        fts.parse(bad)


def test_reading_what_users_type():
    assert fts.read("") is None
    assert fts.read("hash") == fts.Phrase("hash", True)
    assert fts.read("hash", prefix=False) == fts.Phrase("hash")
    assert fts.read("zero-knowledge") == fts.Phrase("zero-knowledge", True)
    assert fts.read("a or b") == fts.Both(fts.Both(fts.Phrase("a"), fts.Phrase("or")), fts.Phrase("b"))
    assert fts.read("aa? OR bb") == fts.Either(fts.Phrase("aa?", True), fts.Phrase("bb", True))
    assert fts.read("aa? OR bb", compat=True) == fts.Both(fts.Both(fts.Phrase("aa?", True), fts.Phrase("OR", True)), fts.Phrase("bb", True))
    with pytest.raises(fts.QueryError):
        fts.read('"')
    assert fts.scope_of("Titles") == "title" and fts.scope_of("x") == "all"


def papers(spark):
    rows = [
        ("2020/1", "On Lattices", "Ana Joël; Bo Poettering", "signing things", "proofs", "2020-01-05T00:00:00Z", 2020, "", "", None),
        ("2021/2", "Hash Functions", "Cy Dee", "lattice based hashing", "keys", "2021-02-01", 2021, "", "", None),
        ("2021/3", "", "", "", "", "", 0, "", "", None),
    ]
    return spark.createDataFrame(rows, "id string, title string, authors string, abstract string, category string, date string, year int, rights string, url string, added timestamp_ntz")


def found(df):
    return sorted(r.id for r in df.select("id").collect())


def test_search_filters_and_scope(spark):
    p = query.searchable(papers(spark))
    ids = lambda **q: found(query.matching(p, Query(**q)))
    assert ids(terms="lattice") == ["2020/1", "2021/2"]
    assert ids(terms="lattice", scope="title") == ["2020/1"]
    assert ids(terms="joel") == ids(terms="Joël") == ["2020/1"]
    assert ids(terms="poettering") == ["2020/1"]
    assert ids(terms="keys") == ["2021/2"]  # the category counts too
    assert ids(author="Poettering, B.") == [] or ids(author="poett") == ["2020/1"]
    assert ids(author="ana joel", scope="title") == ["2020/1"]
    assert ids(before="2020-06-01") == ["2020/1", "2021/3"]
    assert ids(since="2020-06-01") == ["2021/2"]
    assert ids(category="%") == []
    assert [r.id for r in query.search(p, Query(limit=2)).collect()] == ["2021/2", "2020/1"]
    assert query.count(p, Query(terms="lattice", limit=1)).first().n == 2
    assert ids() == ["2020/1", "2021/2", "2021/3"]


def test_highlight(spark):
    mark = mark_phrases([(["hash", "function"], False), (["lattic"], False)])
    show = lambda s: mark(s).replace(OPEN, "[").replace(CLOSE, "]")
    assert show("Hash Functions and lattices, hashing") == "[Hash Functions] and [lattices], hashing"
    assert mark(None) is None and mark("") == ""
    p = query.searchable(papers(spark))
    hit = query.highlighted(query.search(p, Query(terms="title:lattice")), Query(terms="title:lattice")).first()
    assert hit.title_hl == f"On {OPEN}Lattices{CLOSE}" and hit.abstract_hl == "signing things"


def test_null_columns_match_nothing(spark):
    df = spark.createDataFrame([("1", None, None, None, None)], "id string, title string, authors string, abstract string, category string")
    p = query.searchable(df.withColumns({"date": F.lit(None).cast("string"), "year": F.lit(None).cast("int"), "rights": F.lit(""), "url": F.lit("")}))
    assert found(query.matching(p, Query(terms="a"))) == [] and found(query.matching(p, Query(author="x"))) == []
    assert query.matching(p.limit(0), Query(terms="a NOT b")).count() == 0


def test_index_finds_what_the_scan_finds(spark, rows, tmp_path):
    from lectern.operators import postings

    df = spark.createDataFrame(rows, "id string, title string, authors string, abstract string, category string")
    p = query.searchable(df).cache()
    postings.build(p, str(tmp_path / "index"), 16)
    index = spark.read.parquet(str(tmp_path / "index"))
    rng = random.Random(4)
    terms = ["lattices", "knowl", "zero-knowledge proof", "hash OR lattice", "hash NOT proof", "title:signing", "nothing here", '"hash signature"', "^hash", "NEAR(hash proof, 3)"] + [random_expression(rng) for _ in range(8)]
    for text in terms:
        for prefix in (True, False):
            q = Query(terms=text, prefix=prefix)
            assert found(postings.indexed(p, index, q, buckets=16)) == found(query.matching(p, q)), text
    assert postings.candidates(index, fts.parse("ha*")) is None and postings.candidates(index, fts.parse("hash OR ha*")) is None
    assert postings.candidates(index, fts.parse("absent AND hash"), buckets=16).count() == 0
    postings.build(p.limit(0), str(tmp_path / "none"))
