from __future__ import annotations

import pytest

from lectern.llm.lookalike import canonical_values, field_values, unusual_fields

CASES = {
    "Ｇｒｏｕｐ Keys": "Group Keys",
    "Вruna Оdd": "Bruna Odd",
    "Gr​oup­ s": "Group s",
    "a b　c d": "a b c d",
    "k‑out‐of": "k-out-of",
    "Eﬃcient ﬁne": "Efficient fine",
    "Chloé": "Chloé",
    "А Note on": "A Note on",
    "О'Dell": "O'Dell",
    "cтойкости схем": "стойкости схем",
    "x\x07y": "xy",
}
LEGITIMATE = ["α-Biased O(n²) $k$", "О стойкости схем подписи", "Naïve à la Carte", "line\nbreak\ttab\r\n", "日本語　テキスト（注）", "Σ-protocols ∀x ≤ 𝔽", "می‌خواهم", "👩‍💻 ok ❤️", "x̄ mean", "Ελλάδα και α", "", "plain"]


@pytest.fixture(scope="module")
def forms(spark):
    texts = [*CASES, *LEGITIMATE, *CASES.values(), None, "Ｇｒｏｕｐ Keys"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "id int, value string, canonical2 string")
    return {(r.id, r.value): r.canonical for r in canonical_values(df).collect()}, texts


def test_forms(forms):
    got, texts = forms
    assert len(got) == len(texts)
    for (i, value), canonical in got.items():
        assert canonical == (CASES.get(value, value) if value is not None else None), (value, canonical)


def test_canonical_is_stable(spark, forms):
    got, _ = forms
    again = spark.createDataFrame([(i, c) for i, c in enumerate(got.values())], "id int, value string")
    assert all(r.value == r.canonical for r in canonical_values(again).collect())


def test_found(spark):
    df = spark.createDataFrame([("1", "Ｋｅｙ", "ok", None), ("2", "α-x", "Аna Dorn", "x"), ("3", None, "", "y"), ("1", "Ｋｅｙ", "ok", None), (None, "a​b", "", "")], "id string, title string, authors string, value string")
    assert sorted(((r.id or ""), r.field) for r in unusual_fields(df, "id", ("title", "authors")).collect()) == [("", "title"), ("1", "title"), ("2", "authors")]
    assert unusual_fields(df.limit(0), "id", ("title", "authors")).count() == 0
    assert field_values(df, "id", ("title",)).count() == 5


def test_skewed_value(spark):
    df = spark.createDataFrame([(i, "Ｋｅｙ" if i % 3 else f"p{i}") for i in range(900)], "id int, value string")
    rows = canonical_values(df).collect()
    assert len(rows) == 900 and all(r.canonical == ("Key" if r.id % 3 else f"p{r.id}") for r in rows)
