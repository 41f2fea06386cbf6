from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import biblio, dates, names
from lectern.functions.text import tokens_string

NOW = datetime(2024, 5, 20, 12)


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first().y


@pytest.mark.parametrize(
    "name, folded",
    [("Ana  M. López", "ana m lopez"), ("Jörg", "jorg"), ("Jörg", "jorg"), ("Aarne Goethe", "arne gothe"), ("Suetue Sue", "sutue sue"), ("Michael Straße", "michael strasse"), ("Ægir Œuvre", "aegir ouvre"), ("Łukasz Ødegård", "lukasz odegard"), ("", ""), ("---", "")],
)
def test_fold(spark, name, folded):
    assert names.fold_text(name) == folded
    assert one(spark, name, names.fold_name("x")) == folded


@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x17F), max_size=30))
@settings(max_examples=200, deadline=None)
def test_fold_is_idempotent_on_skeleton_free_text(text):
    once = names.ascii_fold_text(text)
    assert names.ascii_fold_text(once) == once


def test_deaccent_and_skeleton(spark):
    assert one(spark, "Émile O'Ñam-Æ", names.deaccent("x")) == "Emile O'Nam-AE" == names.deaccent_text("Émile O'Ñam-Æ")
    assert names.skeleton_text("j van der berg q") == "vanderberg"
    assert one(spark, "j van der berg q", names.skeleton("x")) == "vanderberg"


@pytest.mark.parametrize(
    "byline, needle, hit",
    [("Ana Bela; Cy Dorn", "bela ana", True), ("Ana Bela; Cy Dorn", "ana dorn", False), ("Ana Maria Bela", "an be", True), ("Ana Bela", "a. bela", True), ("Ana Bela", "x bela", True), ("Ana Bela", "q", False), ("Bo Q", "q", True), ("Ana Bela", "", False), ("", "ana", False), ("Søren Aas", "soren as", True)],
)
def test_author_match(spark, byline, needle, hit):
    assert one(spark, byline, names.author_match("x", needle)) is hit


def test_person_form_and_surname(spark):
    assert one(spark, "Dorn, Cy", names.person_form_column("x")) == "Cy Dorn" == names.person_form_text("Dorn, Cy")
    assert one(spark, "Dorn, Cy, Jr.", names.person_form_column("x")) == "Dorn, Cy, Jr."
    assert one(spark, "Cy van Dorn", names.split_surname("x")).asDict() == {"rest": "Cy van", "surname": "Dorn"}
    assert one(spark, "Cy", names.split_surname("x")) is None


@pytest.mark.parametrize("bad", ["2024-o6-01", "2024-13-01", "2024-01-99", "99/01/2024", "13/2024", "", "yesterday", "1é", "2023-02-29", "20245"])
def test_bad_bounds(bad):
    with pytest.raises(ValueError):
        dates.parse_bound(bad, False, NOW)


def test_bounds_and_ranges():
    b = lambda s, u=False: dates.parse_bound(s, u, NOW)
    assert b("02/2024", True) == "2024-03-01" and b("12/2023", True) == "2024-01-01"
    assert b("29/02/2024") == "2024-02-29" and b("2024", True) == "2025-01-01" and b("2024-02-29", True) == "2024-03-01"
    assert b("2w") == b("2w", True) == "2024-05-06" and b("1m") == "2024-04-20" and b("1y") == "2023-05-21"
    assert dates.parse_range("2020..2024", NOW) == ("2020-01-01", "2025-01-01")
    assert dates.parse_range("..2024", NOW) == (None, "2025-01-01") and dates.parse_range("2024..", NOW) == ("2024-01-01", None)
    assert dates.parse_range("03/2024", NOW) == ("2024-03-01", "2024-04-01") and dates.parse_range("3d", NOW) == ("2024-05-17", None)
    for bad in ("2024..2020", "..", ""):
        with pytest.raises(ValueError):
            dates.parse_range(bad, NOW)
    assert dates.date_window("2020", "2021", NOW) == ("2020-01-01", "2021-01-01")
    assert dates.date_window(None, "2021", NOW) == ("2021-01-01", None) and dates.date_window(None, "2021..2022", NOW)[1] == "2023-01-01"
    assert dates.date_window(None, None, NOW) == (None, None)
    assert dates.is_relative("3w") and not dates.is_relative("2024")


def test_date_columns(spark):
    assert one(spark, "2024-03-05T06:07:08Z", dates.display_date("x")) == "05/03/2024"
    assert one(spark, "soon", dates.display_date("x")) == "soon"
    assert one(spark, "2024-03-05T06:07:08Z", dates.format_iso(dates.parse_iso("x"))) == "2024-03-05T06:07:08Z"
    assert one(spark, "2024", dates.parse_iso("x")) is None and one(spark, "2024-99-05", dates.parse_iso("x")) is None
    assert one(spark, "1970-01-11", dates.epoch_day("x")) == 10
    assert str(one(spark, "10", dates.day_of_epoch(F.col("x").cast("int")))) == "1970-01-11"
    for seconds, text in ((89, "just now"), (90, "1 minutes ago"), (5400, "1 hours ago"), (172800, "2 days ago")):
        assert one(spark, str(seconds), dates.human_age("x")) == text


def test_titles_and_ids(spark):
    assert one(spark, r"The {\em Big} \LaTeX Ünion: 2nd", biblio.norm_title("x")) == "the big nion 2nd"
    assert one(spark, "Doe, Jane and Max van Moor and ", biblio.surnames("x")) == ["doe", "moor"]
    assert one(spark, "Report 2014/114, see", biblio.paper_id_in("x")) == "2014/114" and one(spark, "x", biblio.paper_id_in("x")) is None
    for text, ok in (("2026/15", True), ("2026/1523extra", False), ("26/15", False), ("2026-1539", False), ("2026/15\n", False)):
        assert one(spark, text, biblio.is_paper_id("x")) is ok
    assert one(spark, "https://a.example/2020/7.pdf", biblio.normal_id("x", 2026)) == "2020/7" and one(spark, "17", biblio.normal_id("x", 2026)) == "2026/17"


def test_display(spark):
    assert one(spark, "A Bee; C Dee; E Fox", biblio.short_authors("x")) == "Bee, Dee, Fox"
    assert one(spark, "A Bee; C Dee; E Fox; G Hen", biblio.short_authors("x")) == "Bee, Dee et al."
    assert one(spark, "A Bee; C Dee; E Fox; G Hen", biblio.short_authors("x", "hen")) == "Bee, Dee, Hen et al."
    assert one(spark, "", biblio.short_authors("x")) == "—" == one(spark, " ; ", biblio.full_authors("x"))
    assert one(spark, "https://c.example/licenses/by-nc/4.0/", biblio.short_license("x")) == "CC-BY-NC-4.0"
    assert one(spark, "https://c.example/publicdomain/zero/1.0/", biblio.short_license("x")) == "CC0"
    assert one(spark, "a\r\nb\n\n \nc", biblio.paragraphs("x")) == ["a b", "c"]
    assert one(spark, "A Long Title: with many, many more words than six", biblio.slug("x")) == "a-long-title-with-many-many"
    assert one(spark, "2020/7", biblio.file_name("x", F.lit("On Proofs"))) == "2020-0007-on-proofs.pdf"
    assert one(spark, "2020-0007-on-proofs.pdf", biblio.slug_words("x")) == "on proofs"
    assert one(spark, "paper_2020_7.pdf", biblio.names_paper("x", 2020, 7)) is True and one(spark, "paper_2019_7.pdf", biblio.names_paper("x", 2020, 7)) is False
    assert one(spark, "1234567", biblio.megabytes(F.col("x").cast("long"))) == "1.2 MB"
    assert one(spark, "\x1b[1ma\x01b\x02", biblio.visible_length("x")) == 2


@pytest.mark.parametrize("width", [20, 40, 83, 200])
def test_wrap_count_equals_lines(spark, width):
    for text in ("", "one", "word " * 60, "a" * 300 + " b", "some  spaced\nlines and a few more words to wrap around"):
        assert one(spark, text, biblio.wrap_count("x", width)) == len(biblio.wrap_text(text, width))


def test_tokens_string(spark):
    assert one(spark, "", tokens_string("x")) == " " and one(spark, "A-b", tokens_string("x")) == " a b " and one(spark, None, tokens_string("x")) is None
