from __future__ import annotations

import random

import numpy as np

from lectern.llm import linkage
from lectern.llm.linkage import expectation_maximisation, link_works, title_level, title_words


def level(a, b):
    return title_level(title_words(a), title_words(b))


def test_titles():
    full = "Krelb: Code-Based Encryption with Hidden Policies from Local Functions"
    assert level(full, full.upper()) == linkage.SAME
    assert level(full, "{Krelb}: {CodeBased} Encryption -- with Hidden Policies from Local Functions (Short Paper)") == linkage.PART
    assert level(full, "Code Based Encryption with Hidden Policies from Local Functions") == linkage.PART
    assert level(full, full + ", or: How I Learned to Sign") == level(full, full + " (Full Version)") == linkage.PART
    assert level(full, full.replace("Hidden ", "")) == level(full, full.replace("Hidden", "Truly Hidden")) == level(full, full.replace("Code-Based ", "")) == linkage.MORE
    assert level(full, full.replace("Policies", "Polcies")) == level(full, full.replace("Encryption", "Enc.")) == level(full, full.replace("Policies", "Pol.")) == linkage.SLIPS
    assert level(full, full.replace("Code-Based Encryption", "CodeBased Enc.")) == level("Zero-Knowledge Proofs from Learning with Errors", "ZK Proofs from LWE") == linkage.SLIPS
    assert level("A Note on " + full[7:], full[7:]) == linkage.CONTAINED and level(full, full.replace("Hidden", "Linear")) == linkage.REPLACED
    assert level(full, full + ", Part II") == level(full + " I", full + " II") == level(full, "Fast Proofs for Local Functions") == linkage.OTHER
    assert level(full + ", Part 2", full + " II") >= linkage.MORE
    assert level("α-Biased Proofs in Smart Cards", r"$\alpha$-biased proofs in smart cards") == linkage.SAME
    assert level("", "x y z") == 0 and level(None, None) == 0
    for a in (full, "x", "", "A: b (c)", "Part II", "x " * 500):
        assert level(a, a) == (linkage.SAME if a else 0) and level(a, full) == level(full, a)


def test_people_and_years():
    p = linkage.people
    a = p(["Ana Dorn", "Bo van Fox"])
    assert linkage.authors_level(a, p(["Dorn, A.", "van Fox, Bo"])) == 3 and linkage.authors_level(a, p(["B. van Fox", "Zed Zorn"])) == 2
    assert linkage.authors_level(a, p(["Zed Zorn"])) == 0 and linkage.authors_level(a, []) == 4
    assert linkage.authors_level(p(["Dorn Ana"]), p(["Ana Dorn"])) == 3 == linkage.authors_level(p(["van der Fox, Bo"]), p(["Fox, B."]))
    assert linkage.authors_level(p([r"J{\"u}rgen Sm{\'i}th"]), p(["Jürgen Smíth"])) == 3
    assert linkage.year_of("c2019a") == 2019 and linkage.year_of("{2020}") == 2020 and linkage.year_of(None) == linkage.year_of("n.d.") == 0
    assert [linkage.year_level(2000, y) for y in (2000, 2001, 2004, 0)] == [2, 1, 0, 3]


def test_expectation_maximisation():
    rng = np.random.default_rng(3)
    match = rng.random(20000) < 0.1
    good = np.where(match[:, None], rng.random((20000, 3)) < [0.9, 0.8, 0.95], rng.random((20000, 3)) < [0.05, 0.1, 0.2])
    vectors, counts = np.unique(good.astype(int), axis=0, return_counts=True)
    posterior = dict(zip(map(tuple, vectors), expectation_maximisation(vectors, counts.astype(float), (2, 2, 2))))
    assert posterior[1, 1, 1] > 0.95 and posterior[0, 0, 0] < 0.01
    assert expectation_maximisation(np.zeros((0, 3), int), np.zeros(0), (2, 2, 2)).size == 0


def works(n=150, seed=6):
    rng = random.Random(seed)
    w = lambda k: [rng.choice("adaptive batched compact delegated efficient fair generic hybrid incremental keyed lattice masked noisy optimal private quantum robust secure threshold universal".split()) for _ in range(k)]
    names = ["Ana Dorn", "Bo Fox", "Cy Gray", "Di Hill", "Ed Ivy", "Flo Jett", "Gus Kern", "Hal Lund"]
    papers, entries, truth = [], [], set()
    for i in range(n):
        title = " ".join(w(6)).title() + f" {chr(65 + i % 26)}{chr(97 + i // 26)}"
        authors = rng.sample(names, rng.randint(1, 3))
        papers.append((f"2020/{i}", title, "; ".join(authors), 2000 + i % 20, "k", "a"))
        for k in range(rng.choice([0, 0, 1, 2])):
            t = title.split()
            change = rng.randint(0, 3)
            if change == 1:
                del t[rng.randint(0, 4)]
            if change == 2:
                t[2] = t[2][:1] + t[2][2:]
            turned = " and ".join(", ".join(reversed(a.split())) for a in authors)
            entries.append((f"E{i}:{k}", " ".join(t).upper() if change == 3 else " ".join(t), turned, rng.choice([str(2000 + i % 20), str(2001 + i % 20), None, ""]), "id"))
            truth.add((f"2020/{i}", f"E{i}:{k}"))
        if i % 10 == 0:  # the same title by others, another work of the same people
            entries.append((f"X{i}", title, "Zorn, Zed and Yale, Yan", str(2000 + i % 20), "id"))
            entries.append((f"Y{i}", " ".join(w(5)), " and ".join(authors), str(2000 + i % 20), "id"))
    return papers, entries, truth


def test_links(spark):
    papers, entries, truth = works()
    entries += [(None, papers[0][1], "Ana Dorn", "2000", "id"), ("N1", None, "Ana Dorn", "2000", "id"), ("N2", "", None, None, "id"), ("N3", "x" * 4000, None, "2000", "id")]
    entries.append(entries[0])
    p = spark.createDataFrame([*papers, ("0/0", "", "", 0, "k", "a"), ("0/1", None, None, None, None, None)], "id string, title string, authors string, year int, key string, author string")
    e = spark.createDataFrame(entries, "key string, title string, author string, year string, id string")
    rows = link_works(p, e).collect()
    got = {(r.paper_id, r.bib_key) for r in rows}
    assert len(rows) == len(got) and all(0.9 <= r.confidence <= 1 for r in rows)
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.02 * len(got)
    assert link_works(p.limit(0), e).count() == 0 and link_works(p, e.limit(0)).count() == 0


def test_copies_do_not_multiply(spark):
    papers = [(f"2020/{i:03d}", "Keyed Lattice Proofs for Masked Voting", "Ana Dorn", 2020) for i in range(300)]
    more, entries, _ = works(60)
    papers += [("1999/" + p[0][5:], *p[1:4]) for p in more]
    rows = [(f"C{i}", "Keyed Lattice Proofs for Masked Voting", "Dorn, Ana", "2020") for i in range(300)] + [e[:4] for e in entries]
    p = spark.createDataFrame(papers, "id string, title string, authors string, year int")
    e = spark.createDataFrame(rows, "key string, title string, author string, year string")
    features_ = linkage.features(p, "id", "title", "authors", "year", True)
    assert linkage.distinct_features(features_).count() == 61
    got = {r.bib_key: r.paper_id for r in link_works(p, e).collect() if r.bib_key.startswith("C")}
    assert got == {f"C{i}": "2020/000" for i in range(300)}


def test_blocking_against_all_pairs(spark):
    """Of the pairs that a comparison of all records finds alike in title and authors,
    those that some pass brings together; with small blocks too."""
    papers, entries, _ = works(120, seed=9)
    p = spark.createDataFrame([x[:4] for x in papers], "id string, title string, authors string, year int")
    e = spark.createDataFrame([x[:4] for x in entries], "key string, title string, author string, year string")
    a, b = linkage.features(p, "id", "title", "authors", "year", True), linkage.features(e, "key", "title", "author", "year", False)
    every = linkage.compared(a, b, a.select(a["rec"].alias("rec_a")).crossJoin(b.select(b["rec"].alias("rec_b"))))
    alike = {(r.rec_a, r.rec_b) for r in every.filter(f"title >= {linkage.MORE} AND authors >= 2").collect()}
    for block in (1000, 3):
        met = linkage.candidates(a, b, block).collect()
        assert len(met) == len(set(met)) and len(alike & {tuple(r) for r in met}) >= 0.99 * len(alike) > 50


def test_other_years(spark):
    papers, entries, _ = works()
    papers, entries = [p[:4] for p in papers], [e[:4] for e in entries]
    want = {}
    for k in range(12):  # titles that only one paper has
        title, surname = " ".join(f"{'bcdfghklmnpr'[k]}{x}{'zvtsrqpnmlkj'[k]}ok" for x in ("ara", "omi", "enu", "il")), "Plomvart Quistel Rendovak Stiglitzer".split()[k % 4]
        slip = surname[:3] + surname[4:]
        lacking = k % 3
        papers.append((f"1990/{k}", title, "" if lacking == 1 else f"Ana {surname}", 1990))
        author = [None, f"{surname}, Ana", f"{slip}, Ana"][lacking]
        entries.append((f"Q{k}", title, author, ["1991", "1995", None, "1990"][k % 4]))
        want[f"Q{k}"] = f"1990/{k}"
    # nothing tells which of two papers is meant, unless the year does
    papers += [("1991/1", "Greblin Hashing on Wide Trees", "Bo Fox", 1991), ("1991/2", "Greblin Hashing on Wide Trees", "Di Hill", 1996)]
    entries += [("R1", "Greblin Hashing on Wide Trees", "", "2001"), ("R2", "Greblin Hashing on Wide Trees", None, "1996"), ("R3", "Greblin Hashing on Wide Trees", "Zorn, Zed", "2001")]
    p = spark.createDataFrame(papers, "id string, title string, authors string, year int")
    e = spark.createDataFrame(entries, "key string, title string, author string, year string")
    got = {r.bib_key: r.paper_id for r in link_works(p, e).collect() if r.bib_key[0] in "QR"}
    assert got == want | {"R2": "1991/2"}


def test_work_per_record(spark):
    """Texts that many records repeat are taken apart once; a record brings a row per part
    of its title to the blocks, not one per part and author."""
    papers = [(f"2020/{i:03d}", f"Keyed Lattice Proofs for Masked Voting {i % 5}", "Ana Dorn; Bo Fox; Cy Gray; Di Hill", 2020) for i in range(400)] + [("2021/1", None, None, None), ("2021/2", "", "", None)]
    p = spark.createDataFrame(papers, "id string, title string, authors string, year int")
    once = linkage.read_once(linkage._source(p, "id", "title", "authors", "year"))
    assert {r.rec for r in once.collect()} == {*(f"2020/{i:03d}" for i in range(5)), "2021/1"}
    keys = linkage.keys_of(linkage._features(once), True).collect()
    assert len(keys) == 5 * 5 and all(len(k.tags) >= 5 for k in keys)  # the whole title, and three of four words
    e = spark.createDataFrame([(f"C{i}", p_[1], "Dorn, Ana and Fox, Bo and Gray, Cy and Hill, Di", "2020") for i, p_ in enumerate(papers[:400])], "key string, title string, author string, year string")
    got = {r.bib_key: r.paper_id for r in link_works(p, e, 0.0).collect()}
    assert got == {f"C{i}": f"2020/{i % 5:03d}" for i in range(400)}
