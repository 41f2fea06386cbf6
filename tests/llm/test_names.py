from __future__ import annotations

import random

from lectern.llm import metric, variants
from lectern.llm.variants import parse


def edits(a, b):
    """Damerau-Levenshtein: edits may fall between swapped neighbours."""
    far, seen = len(a) + len(b) + 1, {}
    d = {(i, j): far for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + i - k + j - m - 1 if k and m else far)
            match = j if x == y else match
        seen[x] = i
    return d[len(a), len(b)]


def words(n, seed):
    rng = random.Random(seed)
    out = {"", "a", "日本語", "é" * 300}
    while len(out) < n:
        w = "".join(rng.choice(["sa", "ti", "ro", "ke", "lin", "mos"]) for _ in range(rng.randint(1, 5)))
        out.add(w)
        if rng.random() < 0.4:
            k = rng.randint(0, len(w) - 1)
            out.add(w[:k] + rng.choice("abcdé") + w[k + rng.randint(0, 1) :])
    return sorted(out)


def test_distance():
    ws = words(60, 1)
    a, la = metric.encode([x for x in ws for _ in ws])
    b, lb = metric.encode([y for _ in ws for y in ws])
    assert metric.distances(a, la, b, lb).tolist() == [edits(x, y) for x in ws for y in ws]


def test_radius_join_is_exact(spark):
    ws = words(350, 2)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(ws)] + [(None, -1), (ws[3], -2)], "key string, other int")
    want = {(a, b): d for i, a in enumerate(ws) for b in ws[i + 1 :] for d in [edits(a, b)] if d <= 2}
    for more in ({"cell": 8}, {"cell": 60}, {"block": 20}, {"cell": 100, "block": 7}, {}):
        got = {(r.a, r.b): r.distance for r in metric.radius_pairs(df, 2, **more).collect()}
        assert got == want
    assert {(r.a, r.b) for r in metric.radius_pairs(df, 1).collect()} == {p for p, d in want.items() if d < 2}
    asked = df.withColumn("query", df["other"] % 5 == 0)
    chosen = {w for i, w in enumerate(ws) if i % 5 == 0} | ({ws[3]} if -2 % 5 == 0 else set())
    got = {(r.a, r.b) for r in metric.radius_pairs(asked, 2, cell=8).collect()}
    assert got == {p for p in want if chosen & set(p)}
    assert metric.radius_pairs(df.limit(0), 2).count() == 0 and metric.radius_pairs(df.limit(1), 1).count() == 0


def test_parse():
    p = lambda s: {k: v for k, v in parse(s).items() if v}
    assert p("Dorn, Ana M.") == {"shape": "full", "fixed": True, "head": "ana", "words": ["ana"], "middle": "m", "surname": "dorn"}
    assert p("A. M. Dorn")["shape"] == "initial" and p("Dorn A.")["surname"] == "dorn" and p("AM Dorn")["middle"] == "m"
    assert p("van der Dorn, A.")["surname"] == "vanderdorn" and p("van Dorn Ana")["head"] == "ana" and p("Dorn, Ana van")["surname"] == "vandorn"
    assert p("M.-L. Dorn")["head"] == "m" and p("ANA DORN")["shape"] == "full" and p("Ana Dorn, Jr.")["words"] == ["ana", "dorn"]
    assert p("University of Snark")["words"] == ["snark", "university"] == p("SNARK UNIV.")["words"]
    assert parse(None)["shape"] == parse("")["shape"] == parse("Plato")["shape"] == "none"


GROUPS = [
    ["Zachary Groboan", "Groboan, Zachary", "Groboan Zachary", "ZACHARY GROBOAN", "Zachary Grboan", "Zack Groboan", "Groboan, Z.", "Z. Groboan"],
    ["Zofia Groboanski"],
    ["Meera de la Krimmano", "de la Krimmano, Meera", "Krimmano, Meera"],
    ["Mei-Ling Vantrop", "Mei Ling Vantrop", "Meiling Vantrop", "M.-L. Vantrop"],
    ["Jürgen Smörmoal", "Juergen Smoermoal", "Jurgen Smormoal"],
    ["University of Zwelk", "Zwelk University", "ZWELK UNIV."],
    ["Maria Kneilk"],
    ["Mario Kneilk"],
    ["Ana Dorn", "Anna-Li Other"][:1],
    ["Kwame Dorn"],
]


def table(spark):
    rows, truth = [], {}
    filler = [f"{g} {s}" for g in ("Zachary", "Zofia", "Meera", "Jürgen", "Maria", "Mario", "Ana", "Kwame") for s in ("Plomvart", "Quistel", "Rendovak", "Stiglitzer", "Trampolski", "Umbrecht")]
    for group in [*GROUPS, *([f] for f in filler)]:
        for name in group:
            rows.append((len(rows) + 1, name, "x", "y"))
            truth[len(rows)] = group[0]
    rows += [(900, None, "x", "y"), (901, "", "x", "y"), (902, "Plato", "x", "y"), (903, "PLATO", "x", "y"), (904, None, "x", "y")]
    return spark.createDataFrame(rows, "name_id long, name string, key string, group string"), truth


def test_groups(spark):
    df, truth = table(spark)
    aliases = spark.createDataFrame([("Ana Dorn", "hannah dorne"), ("Ana Dorn", None)], "representative string, stray string")
    df = df.unionByName(spark.createDataFrame([(800, "Hannah Dorne", "x", "y")], df.schema))
    truth = truth | {800: "Ana Dorn"}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]} | {(902, 903)}
    got = {(r.name_id_a, r.name_id_b) for r in variants.same_name_pairs(df, aliases).collect()}
    assert got == want
    groups = variants.name_groups(df, aliases).toPandas()
    assert sorted(groups.name_id) == sorted(df.toPandas().name_id)
    assert variants.name_groups(df.limit(0), aliases).count() == 0


def test_closing_groups(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("z1", "z2"), ("z2", "z2")]
    got = {r.key: r.group for r in variants._groups(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {k: v for k, v in got.items() if k < "z"} == {f"n{i:03d}": "n000" for i in range(41)} and got["z2"] == "z1"


def test_slips():
    assert variants._slip("abcd", "abdc") and variants._slip("abc", "abcd") and variants._slip("abc", "axc") and not variants._slip("abc", "cba")
    assert variants._slip("ab", "abc") and not variants._slip("abc", "xyz")


def test_spellings_that_only_bylines_have(spark, tmp_path):
    from lectern.llm import queries

    spark.createDataFrame([("1", "Zachary Groboan; Mei-Ling Vantrop"), ("2", "Zachary Grboan; Zachary Groboan")], "id string, authors string").write.parquet(f"{tmp_path}/papers.parquet")
    spark.createDataFrame([(1, "Groboan, Zachary")], "name_id long, name string").write.parquet(f"{tmp_path}/author_names.parquet")
    spark.createDataFrame([], "representative string, stray string").write.parquet(f"{tmp_path}/aliases.parquet")
    rows = queries.p3_bylines(spark, str(tmp_path)).collect()
    group = {r["name"]: r["group"] for r in rows}
    assert len(rows) == 4 and group["Zachary Groboan"] == group["Zachary Grboan"] == group["Groboan, Zachary"] != group["Mei-Ling Vantrop"]
