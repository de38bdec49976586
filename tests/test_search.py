"""The search engine against plain restatements on small texts."""

import json
import random
import re

import pytest

from pagemark import queries
from pagemark.engine import Engine
from pagemark.functions.stem import stem_en, stem_word
from pagemark.functions.stem_more import stem_de, stem_ru
from pagemark.operators import index, rank
from pagemark.plans.query import Both, Either, QueryError, Word, parse, radius
from pagemark.sources import pages as sources

TEXT = "The old lady met a young lady, and the old ladies were glad. Old Tupman saw 42 cats and an old dog; everybody ran and sang."


def documents(spark, rows):
    return sources.from_rows(spark.createDataFrame(rows, "name string, body string, size int"), "test", "name", "body", ["size"])


@pytest.fixture(scope="module")
def engine(spark):
    pages = documents(spark, [("Sample", TEXT, 190), ("Dump", TEXT + " " + TEXT, None), ("Empty", None, 3)])
    return Engine.build(pages)


def found(engine, request, dist=255, **options):
    rows = engine.search(request, dist, **options).hits.collect()
    return sorted((r.doc, r.page_no, r.pos) for r in rows)


def near(a, b, r, ordered):
    """The island rule, restated."""
    union = sorted(set(a) | set(b))
    islands, last = [], None
    for x in union:
        if last is None or (r and x - last > r):
            islands.append([])
        islands[-1].append(x)
        last = x
    out = []
    for island in islands:
        if ordered:
            first = min((x for x in island if x in a), default=None)
            island = [] if first is None else [x for x in island if x >= first]
        if any(x in a for x in island) and any(x in b for x in island):
            out += island
    return out


def test_single_words_are_found_where_they_stand(engine):
    for word in ("tupman", "everybody", "dog"):
        want = [m.start() for m in re.finditer(rf"\b{word}\b", TEXT.lower())]
        assert [p for d, n, p in found(engine, word) if d == "Sample"] == want
    assert [p for d, n, p in found(engine, "42 cats", 5) if d == "Sample" and n] == [TEXT.index("cats")]  # short words go


def test_stems_join_forms(engine):
    hits = [p for d, _, p in found(engine, "ladies") if d == "Sample"]
    low = TEXT.lower()
    assert hits == [m.start() for m in re.finditer(r"\blad(y|ies)\b", low)]
    assert [p for d, _, p in found(engine, '"lady"') if d == "Sample"] == [m.start() for m in re.finditer(r"\blady\b", low)]


@pytest.mark.parametrize("request_,dist,a,b,ordered", [('"old lady"', 40, "old", "lady", True), ('"lady old"', 40, "lady", "old", True), ("tupman everybody", 5, "tupman", "everybody", False)])
def test_proximity_follows_the_island_rule(engine, request_, dist, a, b, ordered):
    low = TEXT.lower()
    place = lambda w: [m.start() for m in re.finditer(rf"\b{w}\b", low)]
    r = max(len(a), len(b)) + (4 if ordered else dist)
    assert [p for d, n, p in found(engine, request_, dist) if d == "Sample" and n == 1] == near(place(a), place(b), r, ordered)


def test_or_and_brackets(engine):
    union = {p for d, _, p in found(engine, "tupman | dog") if d == "Sample"}
    assert union == {p for w in ("tupman", "dog") for d, _, p in found(engine, w) if d == "Sample"}
    assert found(engine, "old (tupman | dog)", 10)


def test_wildcards_match_inside(engine):
    want = [m.start() for m in re.finditer(r"\w*an\w*", TEXT.lower()) if len(m[0]) > 2]
    assert [p for d, n, p in found(engine, "?an?") if d == "Sample" and n] == want


def test_fields_and_document_filter(engine):
    docs = engine.search("tupman {name=dump}").docs.collect()
    assert [r.doc for r in docs] == ["Dump"]
    assert len({r.doc for r in engine.search("tupman {name=dump}", compat=True).pages.collect()}) == 2
    assert [r.doc for r in engine.search("{size=190}").docs.collect()] == ["Sample"]
    assert [r.doc for r in engine.search("tupman -filter:^sam,umb").docs.collect()] == []
    assert [r.doc for r in engine.search("tupman -filter:ample").docs.collect()] == ["Sample"]


def test_errors_are_results(engine):
    for bad in ("", "(old", 'old "lady', "old | ", "old)"):
        assert engine.search(bad).error
    with pytest.raises(QueryError):
        parse("|")


def test_parse_and_radius():
    assert parse("lady (old | young)").body == Both(Word("lady"), Either(Word("old"), Word("young")))
    assert parse("a old").body == Word("old")
    assert radius(parse('"old lady"').body, 40) == -8 and radius(parse('"lady" old').body, 40) == 43
    assert parse("2024 old").body == Both(Word("2024", True), Word("old"))


def test_ranks(engine, spark):
    hits = spark.createDataFrame([("d", 1, 0), ("d", 1, 7), ("d", 1, 100), ("e", 0, 3)], "doc string, page_no int, pos int")
    got = {(r.doc, r.page_no): r.rank for r in rank.page_ranks(hits).collect()}
    import math

    assert got["d", 1] == pytest.approx(1 + 4 + 0 + math.log(3)) and got["e", 0] == pytest.approx(1)
    docs = {r.doc: r.rank for r in rank.doc_ranks(rank.page_ranks(hits)).collect()}
    assert docs["e"] == pytest.approx(10) and docs["d"] == pytest.approx(1 + math.log(got["d", 1]))


def test_snippets_mark_words(engine):
    shown = rank.snippets(engine.search('"old lady"').pages, engine.pages).collect()
    assert any("ˋold" in r.text.lower() for r in shown) and all(len(r.text) < 400 for r in shown)
    s = {r.doc: r for r in rank.summaries(rank.snippets(engine.search("tupman").pages, engine.pages)).collect()}
    assert s["Dump"].found_words == ["Tupman"]


def test_json_suggestions_and_close_words(engine):
    body = json.loads(engine.json(engine.search("tupman")).first().response)
    assert body["found"] == 2 and {x["doc"] for x in body["result"]} == {"Sample", "Dump"}
    assert [r.suffix for r in engine.suggest("old eve").collect()] == ["rybody"]
    assert engine.close_words("tupmen").first().term == "tupman"


def test_save_and_load(engine, spark, tmp_path):
    engine.save(str(tmp_path))
    again = Engine.load(spark, str(tmp_path))
    assert found(again, "old dog") == found(engine, "old dog")


def test_near_on_random_places(spark):
    from pyspark.sql import functions as F

    from pagemark.plans.compile import near as near_df

    rng = random.Random(4)
    for r in (0, 3, -3, 8, -8):
        a, b = ({rng.randrange(120) for _ in range(15)} for _ in range(2))
        rows = spark.createDataFrame([("d", x, x in a, x in b) for x in sorted(a | b)], "doc string, coord long, a boolean, b boolean")
        got = sorted(x.coord for x in near_df(rows, F.col("a"), F.col("b"), r, "n").where("n").collect())
        assert got == near(a, b, abs(r), r < 0)


def test_stems():
    pairs = {"lady": "ladi", "ladies": "ladi", "works": "work", "working": "work", "generously": "generous", "hopping": "hop", "hoping": "hope", "relational": "relat", "dying": "die", "cries": "cri", "by": "by", "national": "nation", "happiness": "happi"}
    assert {w: stem_en(w) for w in pairs} == pairs


def test_stems_of_other_languages():
    german = {"aufeinander": "aufeinand", "kategorische": "kategor", "häuser": "haus", "möglichkeiten": "moglich", "käuflich": "kauflich"}
    russian = {"вагонов": "вагон", "важнейшие": "важн", "важничал": "важнича", "важностию": "важност", "валяется": "валя", "в": "в"}
    assert {w: stem_de(w) for w in german} == german
    assert {w: stem_ru(w) for w in russian} == russian
    assert [stem_word(w) for w in ("häuser", "вагоны", "ladies", "été", "123", "a1", "")] == ["haus", "вагон", "ladi", None, None, None, None]


def test_russian_and_german_words_are_found_by_stem(spark):
    docs = [("A", "Два вагона, один вагон. Die Straßen und Häuser.", 1)]
    e = Engine.build(documents(spark, docs))
    text = docs[0][1].lower()
    assert [r.pos for r in e.search("вагонов").hits.collect()] == [text.index("вагона")]
    assert [r.pos for r in e.search("häusern").hits.collect()] == [text.index("häuser")]


def test_empty_index(spark):
    e = Engine.build(documents(spark, []))
    assert e.search("old lady").hits.count() == 0 and e.dictionary.count() == 0


def test_page_map_covers_each_document(engine):
    rows = sorted(index.page_map(engine.pages).collect())
    for a, b in zip(rows, rows[1:]):
        assert b.start == (a.end if a.doc == b.doc else 0)


def test_two_fields_gives_every_document(spark, tmp_path):
    """More documents than an answer shows (500), and some that lack a field."""
    rows = [(i, "word", ("en", "de", None)[i % 3], ("src3", "src4")[i % 2]) for i in range(3300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.doc for r in queries.two_fields(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(str(i) for i in range(0, 3300, 6)) and len(got) == 550
