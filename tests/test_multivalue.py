from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from lectern.functions.arrowtext import text_chunks
from lectern.operators.multivalue import split_column, split_values

CASES = {
    "Doe, Jane; Max Moor; li lu": ["Doe, Jane", "Max Moor", "li lu"],
    '"Doe, Jane" , "Moor, Max"': ["Doe, Jane", "Moor, Max"],
    '"Moor, Max", Ana Dorn': ["Moor, Max", "Ana Dorn"],
    "; Ana Dorn; ;  Bo Fox;": ["Ana Dorn", "Bo Fox"],
    "Ana Dorn | Bo Fox / Cy Gray // Di Hill\tEd Ivy": ["Ana Dorn", "Bo Fox", "Cy Gray", "Di Hill\tEd Ivy"],
    "Di Hill\tEd Ivy": ["Di Hill", "Ed Ivy"],
    "Ana Dorn\r\nBo Fox": ["Ana Dorn", "Bo Fox"],
    "Ana Dorn, III; Bo Fox, Jr.": ["Ana Dorn, III", "Bo Fox, Jr."],
    "van Dorn, Ana-Li P.": ["van Dorn, Ana-Li P."],
    "Ana Dorn, Bo Fox": ["Ana Dorn", "Bo Fox"],
    "de ls Dorn, Ana T.": ["de ls Dorn, Ana T."],
    "vam Dorn, A., Fox, B.": ["vam Dorn, A.", "Fox, B."],
    "ana dorn, bo fox": ["ana dorn", "bo fox"],
    "van Dorn Ana, Bo Fox": ["van Dorn Ana", "Bo Fox"],
    "Dorn, A., Fox, B., & Gray, C.": ["Dorn, A.", "Fox, B.", "Gray, C."],
    "Dorn, A., Fox, B. C., and Gray, C.-D.": ["Dorn, A.", "Fox, B. C.", "Gray, C.-D."],
    "A Dorn, B Fox & C Gray": ["A Dorn", "B Fox", "C Gray"],
    "Dorn, Ana and {Wire and Key Group} AND Fox, Bo And Gray, Cy": ["Dorn, Ana", "Wire and Key Group", "Fox, Bo", "Gray, Cy"],
    "Ana Dorn and others": ["Ana Dorn"],
    "Ana Dorn and et al.": ["Ana Dorn"],
    "Ana Dorn et al.": ["Ana Dorn"],
    'Dr{\\"o}mar, M.; Ch{\\^o}star, G.': ['Dr{\\"o}mar, M.', "Ch{\\^o}star, G."],
    '"Office, Key Branch"; Ana Dorn': ["Office, Key Branch", "Ana Dorn"],
    "{{Nested {X}}}": ["Nested {X}"],
    "Sandy Brand": ["Sandy Brand"],
    "Ana Dorn; 　Bo Fox": ["Ana Dorn", "Bo Fox"],
    'Ana "Dorn; Bo Fox': ['Ana "Dorn', "Bo Fox"],
    "": [],
    "  \n": [],
    ";;|": [],
    "and": [],
    "Dorn, Jr., Ana": ["Dorn, Jr., Ana"],
    "日本 太郎; Łi Ø": ["日本 太郎", "Łi Ø"],
}


def split(texts):
    out = []
    for c in text_chunks(pa.array(texts, pa.string())):
        offsets, values = split_column(c.data, c.offsets)
        values = values.to_pylist()
        out += [values[offsets[i] : offsets[i + 1]] for i in range(c.hi - c.lo)]
    return out


@pytest.mark.parametrize("text", CASES)
def test_alone(text):
    assert split([text]) == [CASES[text]]


def test_together():
    texts = [*CASES, None, *reversed(CASES)]
    assert split(texts) == [CASES.get(t, []) for t in texts]


def test_rows(spark):
    df = spark.createDataFrame([("k", "Ana Dorn; Bo Fox", 1), ("k", "Ana Dorn; Bo Fox", 2), ("l", None, 3), (None, "Cy Gray", 4), ("m", "x" * 5000 + " Long; Di Hill", 5)], "key string, author string, name int")
    rows = sorted((r.rec or "", r.pos, r.name) for r in split_values(df, "key", "author", "rec").collect())
    assert rows == [("", 1, "Cy Gray"), ("k", 1, "Ana Dorn"), ("k", 2, "Bo Fox"), ("m", 1, "x" * 5000 + " Long"), ("m", 2, "Di Hill")]
    assert split_values(df.limit(0), "key", "author").count() == 0


def test_et_al_in_any_case():
    data = b"Ana Dorn ET AL."
    _, names = split_column(data, np.array([0, len(data)]))
    assert names.to_pylist() == ["Ana Dorn"]
