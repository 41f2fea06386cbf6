"""The encoder against the tokenizer library, the splitter against its promises."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import bpe, split

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.load_bpe()


def encode(encoder, texts):
    out = []
    for lo, hi, ids, offsets, _ in encoder.encode_column(pa.array(texts, pa.string())):
        out += [ids[offsets[r] : offsets[r + 1]].tolist() for r in range(hi - lo)]
    return out


PIECES = ["'", " ", "  ", "\n", "\t", "s", "ll", "ve", "re", "d", "m", "t", "a", "Zq", "é", "é", "ß", "日本", "12", "½", "!", "...", "\xa0", "　", "👍🏽", "'s", "'LL", "\r\n", "​", "<|endoftext|>", "don't", "'' ", "x" * 30, "Knauggiet", "\x00"]


def test_random_texts(encoder, library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(20000)]
    assert encode(encoder, texts) == library(texts)


def test_every_entry_and_hash(encoder):
    for entry, rank in list(encoder.ranks.items())[::7]:
        assert encoder.merge(entry) == (rank,)
    assert sum(int((c >= 0).sum()) for c in encoder.hash.cells) == sum(len(x) <= bpe.PACKED for x in encoder.ranks)
    numbers = encoder.hash.lookup(encoder.entry_words, encoder.entry_size)
    assert sorted(numbers.tolist()) == list(range(len(numbers)))  # minimal and perfect


def test_long_and_odd_texts(encoder, library, monkeypatch):
    texts = ["a" * 20000 + " " * 500 + "=" * 900, "word " * 3000 + "end", "\n" * 50, " x" * 2000 + "日本語" * 500]
    want = library(texts)
    assert encode(encoder, texts) == want
    monkeypatch.setattr(bpe, "PART_CHARS", 1000)
    assert encode(encoder, texts) == want


def test_documents(spark, library):
    rows = [(1, "Hello, world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello, world", "y"), (None, "<|endoftext|>", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or -1), list(r.ids)) for r in bpe.encode_documents(df).collect())
    hello, special = library(["Hello, world", "<|endoftext|>"])
    assert got == sorted([(1, hello), (1, hello), (2, []), (3, []), (-1, special)])
    assert bpe.encode_documents(df.limit(0)).count() == 0


# -- splitting -------------------------------------------------------------------------


def documents(n=12, seed=4):
    rng = random.Random(seed)
    topics = [["lattice", "vector", "basis", "norm"], ["hash", "digest", "collision", "salt"], ["vote", "ballot", "tally", "mix"]]
    sentence = lambda t: " ".join(rng.choice(topics[t] + ["the", "of", "and"]) for _ in range(12)).capitalize() + ". "
    out = ["", None, " ", "short text", "x" * 9000, "日本語の文。" * 900, "one two " * 1500, "a\n\n" * 2000]
    for _ in range(n):
        out.append("\n\n".join("".join(sentence(t) for _ in range(rng.randint(20, 60))) for t in (0, 1, 2)))
    return out


def test_pieces(spark, library):
    texts = documents()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = split.split_documents(df).orderBy("doc_id", "piece").collect()
    ids = library([t or "" for t in texts])
    for k, text in enumerate(texts):
        mine = [r for r in rows if r.doc_id == k]
        assert [r.piece for r in mine] == list(range(1, len(mine) + 1)) and {r.pieces for r in mine} == {len(mine)}
        assert mine[0].first_token == 0 and mine[-1].end_token == len(ids[k])
        for a, b in zip(mine, mine[1:]):
            assert b.first_token == a.end_token - split.OVERLAP and b.end_token > a.end_token
        assert all(r.end_token - r.first_token <= split.LIMIT for r in mine)
        assert (len(mine) > 1) == (len(ids[k]) > split.LIMIT)
        # new parts of the texts give the text again, and no piece has more tokens than allowed
        assert max(map(len, library([r.text for r in mine]))) <= split.LIMIT
    whole = split.split_documents(df, overlap=0).orderBy("doc_id", "piece").collect()
    for k, text in enumerate(texts):
        assert "".join(r.text for r in whole if r.doc_id == k) == (text or "")
    only = split.split_documents(df, oversized_only=True, with_text=False).select("doc_id").distinct().collect()
    assert {r.doc_id for r in only} == {k for k, i in enumerate(ids) if len(i) > split.LIMIT}
    assert split.split_documents(df.limit(0)).count() == 0


def test_cuts_follow_topics(spark, encoder):
    rng = random.Random(1)
    a = " ".join("Lattice basis vectors shrink under reduction " + rng.choice("abc") + "." for _ in range(70))
    b = " ".join("Ballots remain secret while talliers count mixes " + rng.choice("abc") + "." for _ in range(70))
    df = spark.createDataFrame([(1, a + " " + b)], "doc_id int, text string")
    first = split.split_documents(df, limit=900, overlap=16).orderBy("piece").first()
    assert first.text == a and first.boundary == "sentence"


def test_valleys():
    s = np.array([0.9, 0.2, 0.8, 0.7, 0.75])
    assert split.depths(s).argmax() == 1 and split.depths(s)[1] == pytest.approx(1.3)
    assert split.depths(np.zeros(0)).size == 0
    with pytest.raises(ValueError):
        split.split_documents(None, limit=10, overlap=5)


def test_sections_agree(encoder):
    text = " ".join(f"Word{i % 7} thing{i % 11} over." for i in range(900)).encode()
    ids = np.array(encoder.encode(text.decode()), np.int32)
    sizes = encoder.id_bytes[ids].astype(np.int64)
    at = np.cumsum(sizes) - sizes
    gaps, _ = split.boundaries(text, at)
    whole = split.cohesion(ids, sizes, gaps)
    old = split.SECTION
    try:
        split.SECTION = 17
        assert np.allclose(whole, split.cohesion(ids, sizes, gaps), atol=1e-5)
    finally:
        split.SECTION = old


def test_line_ends_and_early_boundaries(spark, encoder):
    for end, kind in (("\n", "line"), ("\r", "line"), ("\r\n", "line"), (chr(0x2028), "line"), (chr(0x2029), "paragraph"), ("\r\r", "paragraph"), ("\n \n", "paragraph")):
        # the only natural boundary stands in the first half of what a piece may hold
        text = "word " * 300 + "end" + end + "more " * 1500
        rows = split.split_documents(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("piece").collect()
        assert rows[0].boundary == kind and rows[0].text.rstrip().endswith("end") and all(r.boundary == "word" for r in rows[1:-1]), (end, rows[0].boundary)
        assert all(r.end_token - r.first_token <= split.LIMIT for r in rows)
