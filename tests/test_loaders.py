"""Sources by kind, loaders, vocabularies, crawl rules and the stored index."""

import json

import pytest
from pyspark.sql import functions as F

from pagemark.engine import Engine
from pagemark.functions import text as tx
from pagemark.operators import index, words
from pagemark.sources import crawl, pages as sources

HTML = '<html><head><title>T</title><meta name="Author" content="A. N. Other"></head><body>caf&#233; &#x2014; &#99999999; deux</body></html>'


def texts(df):
    return {(r.doc, r.page_no): r.text for r in df.collect()}


def test_folder_by_ending(spark, tmp_path):
    (tmp_path / "a(1)+").mkdir()
    root = tmp_path / "a(1)+"
    (root / "x.txt").write_bytes("Привет, мир и все".encode("cp1251"))
    (root / "y.html").write_text(HTML)
    (root / "z.pdf").write_bytes(b"%PDF-1.4")
    (root / "x.txt.dscr").write_text("Name=own\nTopic=t\nTopic=again\nLate=no\n")
    got = texts(sources.from_folder(spark, "s", str(root)))
    assert got["x.txt", 1] == "Привет, мир и все" and got["x.txt", 0] == "Source=s\nName=own\nTopic=t\n"
    assert got["y.html", 1] == "T café — &#99999999; deux" and "Author=A. N. Other\n" in got["y.html", 0]
    assert {d for d, _ in got} == {"x.txt", "y.html"}


def test_blobs_and_files(spark, tmp_path):
    rows = [(1, b"%PDF-1.7 x"), (2, HTML.encode()), (3, "ä".encode()), (4, None), (5, b"")]
    got = texts(sources.from_blobs(spark.createDataFrame(rows, "id int, b binary"), "s", "id", "b"))
    assert {d for d, _ in got} == {"2", "3", "5"} and got["3", 1] == "ä" and got["2", 1].startswith("T café")
    typed = spark.createDataFrame([("u", "text/plain", b"<html>"), ("v", "application/pdf", b"x")], "u string, t string, b binary")
    assert texts(sources.from_blobs(typed, "s", "u", "b", "t"))["u", 1] == "<html>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    named = spark.createDataFrame([("d", "in\\a.txt"), ("e", "none.txt")], "k string, f string")
    assert texts(sources.from_files(spark, named, "s", "k", "f", str(tmp_path)))["d", 1] == "one"
    manifest = tmp_path / "m.xml"
    manifest.write_text(f"<root><basepath>{tmp_path}/</basepath><document><file>in/a.txt</file></document><document><title>no</title></document></root>")
    assert texts(sources.from_manifest(spark, "s", str(manifest), str(tmp_path)))["in/a.txt", 1] == "one"


def test_stop_words_and_vocabularies(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("; note\nand\n\n  \nthe\nand\n")
    assert index.load_stops(spark, str(tmp_path / "stop.txt")) == ["and", "the"]
    (tmp_path / "voc").mkdir()
    (tmp_path / "voc" / "verbs").write_text("was be VBD\nis be VBZ\nbeen be VBN\nran run VBD\n\nlone\n")
    lemmas = words.freeling(spark, str(tmp_path / "voc"))
    grouped = words.numbered(words.vocabulary(lemmas, stems=False))
    groups = {}
    for r in grouped.collect():
        groups.setdefault(r.grp, set()).add(r.stem)
    assert sorted(map(sorted, groups.values())) == [["be", "been", "is", "was"], ["ran", "run"]]
    both = index.vocabularies(spark.createDataFrame([("zzz", 1)], "stem string, grp int"), grouped)
    grp = next(k for k, v in groups.items() if "run" in v)
    assert words.group_members(both, f"#{(1 << 24) | grp:X}") == "ran,run"
    (tmp_path / "d.xml").write_text('<dictionary><lemmata><lemma id="1"><l t="ёж"><g v="N"/></l><f t="ежа"/><f t="ежу"/></lemma><lemma id="2"><l t="дом"/></lemma></lemmata></dictionary>')
    assert sorted((r.lemma, r.word) for r in words.opencorpora(spark, str(tmp_path / "d.xml")).collect()) == [("дом", "дом"), ("ёж", "ежа"), ("ёж", "ежу"), ("ёж", "ёж")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = [("x", "alpha was here and alpha ran", "red", "blue"), ("y", "delta been there", "red", "far")]
    make = lambda source, rows: sources.from_rows(spark.createDataFrame(rows, "n string, t string, aaa string, zzz string"), source, "n", "t", ["aaa", "zzz"])
    pages = make("one", rows).union(make("two", [("x", "delta and nothing else", "red", "green")]))
    voc = spark.createDataFrame([("was", 7), ("been", 7)], "stem string, grp int")
    Engine.build(pages, ("and",), stems=False, vocabulary=voc).save(path)
    return Engine.load(spark, path, stems=False)


def names(found):
    return sorted((r.source, r.doc) for r in found.docs.collect())


def test_stored_index(spark, stored):
    assert stored.stops == ("and",) and stored.vocabulary.count() == 2
    assert names(stored.search("alpha delta")) == [] and names(stored.search("alpha | delta")) == [("one", "x"), ("one", "y"), ("two", "x")]
    assert names(stored.search("been")) == [("one", "x"), ("one", "y")]  # by the vocabulary's group
    assert names(stored.search("delta -filter:^two:")) == [("two", "x")]
    assert names(stored.search("{aaa=red} {zzz=blue}", 20)) == [("one", "x")] and names(stored.search("{aaa=red} {zzz=blue}", 1)) == []
    assert index.term_count(stored.dictionary) == stored.dictionary.count() and index.max_coord(stored.pages) > 0
    plan = stored.search("alpha (here | th?re)").hits._jdf.queryExecution().toString()
    assert "In(term" in plan or "in(term" in plan.lower()
    assert Engine().search("alpha").error == "Index is not built"


def test_answers_are_whole(spark, stored):
    (row,) = stored.documents(stored.search("alpha")).collect()
    assert row.headers == {"Name": "x", "Source": "one", "aaa": "red", "zzz": "blue"} and row.found_words == ["alpha"]
    assert [(p.page_no, p.positions) for p in row.pages] == [(1, [0, 19])] and "ˋalphaˊ" in row.summary
    body = json.loads(stored.json(stored.search("alpha")).first().response)
    assert body["found"] == 1 and body["result"][0]["pages"][0]["positions"] == [0, 19] and json.loads(body["result"][0]["headers"])["aaa"] == "red"


def test_words_may_be_prepared(spark):
    pages = sources.from_rows(spark.createDataFrame([("x", "co-opera tive")], "n string, t string"), "s", "n", "t", [])
    e = Engine.build(pages, stems=False, prepare=lambda w: F.when(w != "tive", F.concat(w, F.lit("x"))))
    assert e.search("operax").hits.count() == 1 and e.search("tivex").hits.count() == 0


def test_crawl(spark):
    site = {"http://h/": '<a href="/a">1</a><a href="http://other/b">2</a><a href="i.png">3</a><a href="#top">4</a>', "http://h/a": '<a href="b?x#y">5</a><meta http-equiv="refresh" content="0; url=/d/e">', "http://h/b?x": "end", "http://h/d/e": '<a href="f">6</a>', "http://h/d/f": "", "http://other/b": "", "http://h/lost": ""}
    pages = spark.createDataFrame(list(site.items()), "url string, html string")
    assert sorted((r.url, r.depth) for r in crawl.crawl(pages, "http://H/").collect()) == [("http://h/", 0), ("http://h/a", 1), ("http://h/b?x", 2), ("http://h/d/e", 2), ("http://h/d/f", 3)]
    assert [r.url for r in crawl.crawl(pages, "http://h/", "/d/", 1).collect()] == ["http://h/d/e"]


def test_numeric_entities(spark):
    got = spark.createDataFrame([("a&#65;&#x42;&#0;&#xD800;",), ("&#128512;",), ("none",), ("",), (None,)], "t string").select(tx.numeric_entities(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["aAB&#0;&#xD800;", "😀", "none", "", None]
