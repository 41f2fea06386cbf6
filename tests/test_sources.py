from __future__ import annotations

import io
import json
import urllib.error

import pytest

from lectern.operators.watch import Watch
from lectern.sources import bibtex, files, oai

BIB = r'''% a comment
@String{crypt = "Crypt " # conf}
@string(conf = {Conference})
@string{loop = loop}

@InProceedings{A:One20,
  title = {A {Nested {Title}} of "Things"},
  Author = "Doe, Jane and {Key Group}",
  year = 2020,
  month = mar,
  booktitle = crypt # { 2020},
  note = {},
}
@misc{E:Two, title = "Two {"}quoted{"}", year = {2021}, howpublished = "Report 2021/7", x = loop}
@article{broken, title = {never closed
'''


def test_bibtex(spark, tmp_path):
    path = tmp_path / "a.bib"
    path.write_text(BIB)
    macros = bibtex.read_macros(spark, str(path))
    assert set(macros) == {"crypt", "conf", "loop"}
    rows = {r.key: r for r in bibtex.rebuilt(bibtex.read_bibtex(spark, str(path), macros), macros).collect()}
    assert set(rows) == {"A:One20", "E:Two"}
    one, two = rows["A:One20"], rows["E:Two"]
    assert (one.kind, one.title, one.author, one.year, one.howpublished) == ("inproceedings", 'A {Nested {Title}} of "Things"', "Doe, Jane and {Key Group}", "2020", "")
    assert (two.title, two.year, two.howpublished) == ('Two {"}quoted{"}', "2021", "Report 2021/7")
    assert "= 2020,\n" in one.entry and "= mar,\n" in one.entry and "= {Crypt Conference 2020}" in one.entry and "note" not in one.entry
    compat = {r.key: r.year for r in bibtex.read_bibtex(spark, str(path), macros, compat=True).collect()}
    assert compat == {"A:One20": "", "E:Two": "2021"}
    assert bibtex.expand([("bare", "loop")], {"loop": "loop"}) == "" and bibtex.expand([("bare", "nix")], {}) == "nix"
    assert bibtex.parse_entry("no entry") is None


def record(body, status=""):
    return f'<record><header{status}>{body[0]}</header><metadata><oai:dc xmlns:oai="o" xmlns:dc="d">{body[1]}</oai:dc></metadata></record>'


PAGE = (
    '<?xml version="1.0"?><OAI-PMH><responseDate>2024-01-02T03:04:05Z</responseDate><ListRecords>'
    + record(("<identifier>oai:a:2020/1</identifier><datestamp>2020-01-01</datestamp>", "<dc:title>old</dc:title><dc:title> New </dc:title><dc:creator>Ana Dorn</dc:creator><dc:creator>Bo Fox</dc:creator><dc:description>x</dc:description><dc:date>2020-01-01</dc:date>"))
    + '<record><header status="deleted"><identifier>oai:a:2020/2</identifier></header></record>'
    + record(("<datestamp>2020-01-01</datestamp>", "<dc:title>no id</dc:title>"))
    + "<resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>"
)


def test_saved_pages(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PAGE.replace("{token}", ""))
    rows = {r.id: r for r in oai.read_pages(spark, str(tmp_path / "p.xml")).collect()}
    assert set(rows) == {"oai:a:2020/1", "oai:a:2020/2"}
    live = rows["oai:a:2020/1"]
    assert (live.op, live.title, live.creators, live.subjects, live.rights) == ("live", "New", ["Ana Dorn", "Bo Fox"], [], None)
    assert rows["oai:a:2020/2"].op == "deleted" and rows["oai:a:2020/2"].title is None


def test_pages_over_the_network():
    asked, slept, answers = [], [], [urllib.error.HTTPError("u", 503, "busy", {"Retry-After": "99"}, io.BytesIO()), PAGE.replace("{token}", "t 1"), '<OAI-PMH><error code="noRecordsMatch">none</error></OAI-PMH>']

    def opener(url):
        asked.append(url)
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    out = list(oai.pages("http://x", "2024-01-01T00:00:00Z", opener, slept.append))
    assert [len(r) for r, _ in out] == [2, 0] and out[0][1] == "2024-01-02T03:04:05Z"
    assert asked[0].endswith("&from=2024-01-01T00%3A00%3A00Z") and asked[-1].endswith("resumptionToken=t%201") and slept[0] == 30.0
    with pytest.raises(RuntimeError):
        oai.parse_page('<OAI-PMH><error code="badArgument">no</error></OAI-PMH>')
    with pytest.raises(urllib.error.HTTPError):
        oai.fetch("u", lambda _: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "", {}, io.BytesIO())), slept.append)
    assert oai.url_quote("a~b c/d") == "a~b%20c%2Fd"


def test_registered_source(spark):
    spark.dataSource.register(oai.OaiSource)
    assert spark.read.format("oai").option("url", "http://127.0.0.1:9").load().schema == oai.RECORD


def test_config_and_state(tmp_path):
    settings, watches = files.parse_config("limit = 5 # five\nfeed_floor = 0\nlimit = x\nnope = 1\nscope=title\nwatch = hash -a \"Ana Dorn\"\nwatch = \nwatch = key\n")
    assert settings == {"limit": 5, "scope": "title"} and watches == [Watch("hash", "Ana Dorn"), Watch("key")]
    again = files.parse_config(files.set_watches("limit = 5\nwatch = a\n", watches))
    assert again == ({"limit": 5}, watches)
    state = files.State(str(tmp_path / "s.json"))
    assert state.get("x") is None
    state.set({"x": "1"})
    state.set({"y": "2"})
    assert state.all() == {"x": "1", "y": "2"}


def test_library_and_json(spark, tmp_path):
    for name in ("2020-0012-on-keys.pdf", "2020-0002.pdf", "notes.pdf", "2021-0001.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    assert [(r.id, r["size"]) for r in files.library(spark, str(tmp_path)).collect()] == [("2020/12", 4), ("2020/2", 4)]
    assert files.library_size(files.library(spark, str(tmp_path))).first().asDict() == {"files": 2, "bytes": 8}
    row = spark.createDataFrame([("1", "T", "A B; C D", "", "", "2024", 2024, "r", "u")], "id string, title string, authors string, abstract string, category string, date string, year int, rights string, url string")
    out = json.loads(files.json_rows(row).first().json)
    assert out["authors"] == ["A B", "C D"] and out["license"] == "r" and len(out) == 9
    with pytest.raises(ValueError):
        files.replace_all(row.limit(0), str(tmp_path / "out"))
    files.replace_all(row, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_shared_folder(spark):
    from pathlib import Path

    from lectern import session

    df = spark.range(3)
    assert sorted(r.id for r in session.written(df, "three").collect()) == [0, 1, 2] and session.checkpoint(df).count() == 3
    folder = Path(session.own_folder(spark).removeprefix("file://"))
    assert any(p.name.startswith("three-") for p in folder.iterdir())
    session.clear(spark)
    assert not folder.exists()
    assert session.spread(df).rdd.getNumPartitions() == 8


def test_entry_with_an_at_sign_at_a_line_start(spark, tmp_path):
    text = (
        "@article{a1,\n  title = {One},\n  note = {mail\n@home or\n@work{x} now},\n  year = 2001\n}\n"
        "@misc{broken, title = {never closed\n"
        "@book{b2, title = {Two}, author = {A \\{ B}}\n@misc(c3, title = \"Three\")\n"
    )
    (tmp_path / "x.bib").write_text(text)
    (tmp_path / "y.bib").write_text("@misc{d4, title = {Four}}\n@misc{e5, title = {Fi\n@ve}}\n")
    got = {r.key: (r.title, r.year) for r in bibtex.read_bibtex(spark, str(tmp_path / "*.bib")).collect()}
    assert got == {"a1": ("One", "2001"), "b2": ("Two", ""), "c3": ("Three", ""), "d4": ("Four", ""), "e5": ("Fi\n@ve", "")}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "z.bib").write_text("")
    assert bibtex.read_bibtex(spark, str(tmp_path / "empty")).count() == 0


def test_refresh_asks_only_for_what_is_new(tmp_path):
    import io
    import urllib.error
    from datetime import datetime

    asked = []

    class Answer(io.BytesIO):
        status, headers = 200, {"ETag": "v2"}

    def opener(request):
        asked.append(request.headers.get("If-none-match"))
        if asked[-1] == "v2":
            raise urllib.error.HTTPError(request.full_url, 304, "same", {}, None)
        return Answer(b"@misc{a, title = {A}}")

    state, target, now = files.State(str(tmp_path / "s.json")), str(tmp_path / "x.bib"), datetime(2025, 1, 1)
    refresh = lambda rows, force=False: bibtex.refresh("http://x/y.bib", target, state, rows, now, force, opener)
    assert refresh(0) and not refresh(5) and refresh(0) and refresh(5, force=True)
    assert asked == [None, "v2", None, None] and state.get(bibtex.REFRESHED) == "2025-01-01T00:00:00"
    assert (tmp_path / "x.bib").read_text().startswith("@misc")


def test_pages_with_an_error(spark, tmp_path):
    page = '<OAI-PMH><responseDate>2025-01-0{}T00:00:00Z</responseDate>{}</OAI-PMH>'
    (tmp_path / "none.xml").write_text(page.format(1, '<error code="noRecordsMatch">nothing</error>'))
    assert oai.read_pages(spark, str(tmp_path / "none.xml")).count() == 0
    (tmp_path / "bad.xml").write_text(page.format(1, '<error code="badResumptionToken">expired</error>'))
    with pytest.raises(RuntimeError, match="expired"):
        oai.read_pages(spark, str(tmp_path))


def test_harvest_stores_the_first_pages_time(tmp_path):
    record = "<record><header><identifier>oai:x:2025/{}</identifier></header><metadata><dc><title>t</title></dc></metadata></record>"
    page = "<OAI-PMH><responseDate>2025-01-0{}T00:00:00Z</responseDate><ListRecords>{}{}</ListRecords></OAI-PMH>"
    answers = [page.format(3, record.format(1), "<resumptionToken>n</resumptionToken>"), page.format(4, record.format(2), "")]
    state, kept, asked = files.State(str(tmp_path / "s.json")), [], []

    def opener(url):
        asked.append(url)
        return answers[len(asked) - 1]

    assert oai.harvest("http://x", state, kept.extend, opener=opener, sleep=lambda _: None) == 2 and len(kept) == 2
    assert state.get(oai.LAST_HARVEST) == "2025-01-03T00:00:00Z"
    answers[:] = [page.format(5, "", "<resumptionToken>n</resumptionToken>"), '<OAI-PMH><error code="x">down</error></OAI-PMH>']
    asked.clear()
    with pytest.raises(RuntimeError):
        oai.harvest("http://x", state, kept.extend, opener=opener, sleep=lambda _: None)
    assert "from=2025-01-03T00%3A00%3A00Z" in asked[0] and state.get(oai.LAST_HARVEST) == "2025-01-03T00:00:00Z"


def test_watches_with_a_number_sign():
    watches = [Watch("c# lattice"), Watch("proof #1", "Ana Dorn"), Watch(r"a \# b"), Watch("#x")]
    assert files.parse_config(files.set_watches("", watches))[1] == watches
    assert files.parse_config("watch = c# lattice # mine\n")[1] == [Watch("c# lattice")]


def test_replacing_tables(spark, tmp_path):
    from lectern.operators import cdc

    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    path, folder = f"{tmp_path}/t", f"file://{tmp_path}/p"
    files.replace_all(df, path)
    files.replace_all(spark.read.parquet(path).filter("n = 1"), path)  # what it reads is replaced last
    assert [r.n for r in spark.read.parquet(path).collect()] == [1] and [p.name for p in tmp_path.iterdir()] == ["t"]
    files.replace_published(df, folder)
    with pytest.raises(ValueError):
        files.replace_published(df.limit(0), folder)
    assert cdc.current(spark, folder).count() == 2
