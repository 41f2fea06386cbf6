from __future__ import annotations

import random

import numpy as np

from lectern.llm import leakage
from lectern.llm.leakage import Skeleton, find_leaks

SK = Skeleton()


def plain(text):
    return "".join(map(chr, SK.of(text or "")))


def brute(documents, items, words=8):
    out = set()
    for i, text in items:
        parts = (text or "").split(" ")
        parts = [p for p in parts if p]
        for k in range(len(parts) - words + 1):
            needle = "".join(plain(p) for p in parts[k : k + words])
            if needle:
                out |= {(i, d) for d, t in documents if needle in plain(t)}
    return out


def disguise(text, rng):
    swap = dict(zip("aeocpyx", "аеосрух"))
    out = []
    for c in text:
        r = rng.random()
        out.append(swap.get(c, c) if r < 0.1 else c + "​" if r < 0.15 else c.upper() if r < 0.2 else "-\n" + c if r < 0.23 else chr(ord(c) + 0xFEE0) if r < 0.26 and "!" <= c <= "~" else c)
    return "".join(out)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["lattice", "vote", "key", "a", "I", "x", "signature", "hash", "42", "7", "of", "naïve", "über", "the", "-", "proof,"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, sentence(rng.randint(3, 30))) for k in range(40)] + [(40, None), (41, ""), (42, "a b c d e f g h"), (43, "a b c d e f g h i")]
    items.append((44, items[0][1]))
    documents = []
    for d in range(160):
        text = sentence(rng.randint(0, 60))
        if rng.random() < 0.6:
            parts = [p for p in (rng.choice(items)[1] or "").split(" ")]
            a = rng.randint(0, max(0, len(parts) - 8))
            part = " ".join(parts[a : a + rng.choice([6, 7, 8, 9, 20])])
            text = text + " " + disguise(part, rng) + " " + sentence(5)
        documents.append((d, text))
    documents += [(500, None), (501, ""), (502, " \n"), (503, "a b c d e f g h i j"), (503, "a b c d e f g h i j")]
    docs = spark.createDataFrame(documents, "doc_id int, text string").withColumnRenamed("item_id", "x").repartition(3)
    its = spark.createDataFrame([(i, t, "test", 0) for i, t in items], "item_id int, text string, split_name string, doc_id int")
    found = find_leaks(docs, its)
    got = {(r.item_id, r.doc_id) for r in found.filter("equal_words >= 8").collect()}
    assert got == brute(documents, items) and len(got) > 20
    # a bitmap that lets nearly everything through, and short comparisons, change nothing
    monkeypatch.setattr(leakage, "BITMAP_BITS", (8, 8))
    monkeypatch.setattr(leakage, "CELLS", 200)
    assert sorted(find_leaks(docs, its).collect()) == sorted(found.collect())
    assert find_leaks(docs.limit(0), its).count() == 0 and find_leaks(docs, its.limit(0)).count() == 0


def test_substitutions_are_tolerated(spark):
    item = "when the first dealer fails another honest auditor opens several hundred shares of the secret"
    changed = item.replace("honest", "honezt").replace("hundred", "hundrod").replace("first", "firsd")
    docs = spark.createDataFrame([(1, "so " + changed + " again"), (2, "nothing like it at all in this text here")], "doc_id int, text string")
    rows = find_leaks(docs, spark.createDataFrame([(7, item)], "item_id int, text string")).collect()
    assert [(r.item_id, r.doc_id) for r in rows] == [(7, 1)] and rows[0].equal_words < leakage.WORDS and rows[0].share > 0.9


def best_share(item, text):
    """By brute force: the best share over windows of eight words on any one diagonal."""
    parts = [SK.of(p) for p in item.split(" ")]
    at, whole, there = np.cumsum([0, *map(len, parts)]), np.concatenate(parts), SK.of(text)
    best = 0.0
    for shift in range(-len(whole), len(there)):
        laid = np.zeros(len(whole), np.uint32)
        a, b = max(0, -shift), min(len(whole), len(there) - shift)
        if a < b:
            laid[a:b] = there[a + shift : b + shift]
            total = np.append(0, np.cumsum(laid == whole))[at]
            best = max(best, ((total[8:] - total[:-8]) / (at[8:] - at[:-8])).max())
    return best


def test_recall_of_substitutions(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(4, 7)))
    items, documents, cases = [], [], {}
    for i in range(60):
        parts = [word() for _ in range(8)]
        items.append((i, " ".join(parts)))
        whole = "".join(parts)
        for share in (0.95, 0.9, 0.85, 0.8):
            text = list(whole)
            for k in rng.sample(range(len(text)), int(len(text) * (1 - share) + 1e-9)):
                text[k] = "0"
            cases[len(documents)] = (i, share)
            documents.append((len(documents), "xyz " + "".join(text) + " xyz"))
        k = rng.randint(1, 6)
        if 1 - len(parts[k]) / len(whole) >= 0.8:
            cases[len(documents)] = (i, "word")
            documents.append((len(documents), " ".join([*parts[:k], "0" * rng.choice([2, 3, 9, 12]), *parts[k + 1 :]])))
    found = {(r.item_id, r.doc_id) for r in find_leaks(spark.createDataFrame(documents, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()}
    share = {kind: np.mean([(i, d) in found for d, (i, k) in cases.items() if k == kind]) for kind in (0.95, 0.9, 0.85, 0.8, "word")}
    print(share)
    assert share[0.95] >= 0.98 and share[0.9] >= 0.98 and share[0.85] >= 0.92 and share[0.8] >= 0.8 and share["word"] >= 0.98


def test_recall_of_random_substitutions(spark):
    """One window of each item in a document, a share of its letters replaced by others at
    random: of the windows that still reach the reported share, at least nine in ten."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 25)))) for i in range(80)]
    documents, cases = [], {0.05: [], 0.1: [], 0.15: []}
    for rate, wanted in cases.items():
        for i, text in items:
            parts = text.split(" ")
            k = rng.randint(0, len(parts) - 8)
            window = "".join(rng.choice(letters) if c != " " and rng.random() < rate else c for c in " ".join(parts[k : k + 8]))
            document = " ".join([word() for _ in range(20)] + [window] + [word() for _ in range(20)])
            if best_share(text, document) >= leakage.LEAST_SHARE:
                wanted.append((i, len(documents)))
            documents.append((len(documents), document))
    found = {(r.item_id, r.doc_id) for r in find_leaks(spark.createDataFrame(documents, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()}
    recall = {rate: np.mean([w in found for w in wanted]) for rate, wanted in cases.items()}
    print(recall, {rate: len(wanted) for rate, wanted in cases.items()})
    assert min(recall.values()) >= 0.9


def test_skeleton():
    assert plain("Ａ-b­С​ é é 1") == "abce" + "́" + "e" + "́" + "1"
    assert plain("ﬁne I") == "finei" and plain("") == "" and plain("Ω") == "ω"
