"""Every operator against a plain version on small tables with nulls, ties, repeats and clashes."""

import hashlib
import itertools
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemark.llm.common import materialise
from pagemark.llm import bpe, components, packing, pii, quality_model, quality_rules, simhash, token_files, tokens, tool_calls, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, stock=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) if rng.random() < 0.7 else rng.choice(("the", "of", "and")) for _ in range(n))


LONG = words(25_000, 99)
BASE = words(300, 1)
ROWS = [
    (5, BASE, "en", "a"), (2, BASE, "en", "a"), (7, BASE.replace("the", "the", 1) + " tail", "en", None), (None, BASE, None, "a"),
    (9, None, "en", "a"), (10, "", "de", "b"), (11, " \n\t ", "de", "b"), (12, "One two", None, None), (12, "One two", None, None),
    (13, LONG, "en", "a"), (14, words(120, 3), "fr", "b"), (15, "same line\n" * 30 + words(60, 4), "en", "a"), (16, "mail me: a.b@x.org +49 170 1234567 or 10.0.0.1 now", "en", "b"),
    (17, "x y z \x1c é İ Σ ΑΣ <|endoftext|> <|STARTOFTEXT|> don't 12ab", "el", "b"), (18, "#$ " * 80 + words(80, 5), "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """The same rows with extra columns that have the names of outputs."""
    return docs.withColumns({c: F.lit("x") for c in ("fp", "kept", "score", "row", "piece", "length", "spans", "n_words", "key", "part", "max_symbols", "y", "component_id")})


@pytest.fixture(scope="module")
def awkward(docs):
    """The same rows beside columns whose names differ in case only, or are those used inside."""
    names = ("TEXT", "Doc_Id", "LANG", "__pm_t", "__pm_i", "__pm_h", "__pm_null", "__pm_text", "__pm_key", "__pm_toxic", "__pm_q_lang", "__pm_max_symbols", "c0", "c1", "i", "n", "bits", "node")
    return docs.select(*[F.lit("no").alias(c) for c in names], "*")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(docs, clash, none):
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(docs).collect()]
    prints = [(r[0], fingerprint(r[1])) for r in ROWS]
    label = {f: f for _, f in prints}
    for _ in label:
        for f in label:
            for g in label:
                if (f ^ g).bit_count() <= 4:
                    label[f] = label[g] = min(label[f], label[g])
    least = defaultdict(lambda: None)
    for d, f in prints:
        if d is not None:
            least[label[f]] = d if least[label[f]] is None else min(d, least[label[f]])
    assert sorted(got, key=str) == sorted(((d, f, least[label[f]]) for d, f in prints), key=str)
    assert rows_of(simhash.simhash_groups(clash)) == rows_of(simhash.simhash_groups(docs))
    assert simhash.simhash_groups(none).count() == 0


def test_simhash_links_are_complete(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(300)]
    flipped = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for b in base for _ in range(2)]
    every = sorted({*base, *flipped, 0, 1, (1 << 64) - 1})
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in every], "fp long")
    roots = dict((r.node % (1 << 64), r.root) for r in components.connected_components(simhash.links(nodes)).collect())
    label = {x: x for x in every}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(every):
        for y in every[:i]:
            if (x ^ y).bit_count() <= 4:
                label[top(x)] = top(y)
    for i, x in enumerate(every):
        for y in every[:i]:
            assert (top(x) == top(y)) == (x in roots and roots.get(x) == roots.get(y)), (x, y)


def test_near_dedup_keeps_one_of_each_class(docs, clash, none):
    kept = simhash.near_dedup(clash)
    assert kept.columns == clash.columns and simhash.near_dedup(none).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert 2 in ids and 5 not in ids and None not in ids and ids.count(12) == 1 and ids.count(9) == 1 and 10 not in ids


def test_near_dedup_links_edited_copies(spark):
    """The classes are those of all pairs of 5-word shingle sets with a Jaccard of 0.8 or more."""
    rng = random.Random(21)
    texts = []
    for b in range(25):
        base = words(rng.choice((60, 90, 200)), 500 + b).split()
        texts.append(base)
        for _ in range(7):
            copy = list(rng.choice(texts[-3:]) if rng.random() < 0.3 else base)
            for _ in range(rng.randint(1, max(2, len(base) // 40))):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(10**6)
            texts.append(copy)
    order = list(range(len(texts)))
    rng.shuffle(order)
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in zip(order, texts)}
    label = {i: i for i in sets}
    for _ in range(8):
        for i in sets:
            for j in sets:
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(order, texts)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_dedup(docs).collect()}
    assert kept == set(label.values()) and 25 <= len(kept) < len(texts) - 50


def test_near_dedup_compares_families_below_the_limit(spark):
    """Texts that share two thirds, with a few real links among them: classes as of all pairs, and no table of all pairs."""
    rng = random.Random(5)
    base = words(120, 77).split()
    texts = []
    for i in range(150):
        texts.append(base[:85] + words(40, 9000 + i).split())
        if i % 10 == 0:
            texts.append([*texts[-1][:-3], "edited", "at", "end"])
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 5 * len(a & b) >= 4 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    rows = [simhash.shingles([" ".join(t)])[0] for t in texts]
    prints = np.array([np.frombuffer(x, np.uint64) for x in simhash.wide_prints(rows)])
    got = simhash._wide_links(prints, prints, np.arange(len(texts)), simhash.FIRST[0], simhash.RADIUS[0], True, simhash._alike(rows, rows))
    assert len(got[0]) == len(texts) - len(set(label)) and all(label[p] == label[q] for p, q in zip(*got))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == set(label)


def made_by_generate(spark, run):
    """The largest number of rows that an explode made while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for k in range(before, store.executionsCount()):
        done = store.executionsList(k, 1).head()
        values, nodes = store.executionMetrics(done.executionId()), store.planGraph(done.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if node.name() == "Generate" and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_near_dedup_tables_grow_with_the_input(spark):
    """Three times as many different texts of one size make three times the rows."""
    rng = random.Random(31)
    rows = [(i, " ".join("%x" % rng.getrandbits(24) for _ in range(60))) for i in range(12_000)]
    made = []
    for n in (4_000, 12_000):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string")
        made.append(made_by_generate(spark, lambda d=docs: made.append(simhash.near_dedup(d).count())))
    assert made[0] == 4_000 and made[2] == 12_000 and 0 < made[1] and made[3] <= 3.3 * made[1]


def test_near_dedup_cuts_large_groups(spark, monkeypatch):
    """A group above the limits is compared in tiles, with the classes of all pairs."""
    monkeypatch.setattr(simhash, "WIDE_TILE", 12)
    monkeypatch.setattr(simhash, "TILE_BYTES", 1 << 14)
    base = words(150, 77).split()
    texts = []
    for i in range(120):  # a chain whose ends differ, of several sizes, and texts outside it
        base[i % 140] = "edit%d" % i
        texts.append(base + words(3 * (i % 7), 300 + i).split())
        if i % 8 == 0:
            texts.append(words(80 + i, 700 + i).split())
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    label = list(range(len(texts)))
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == set(label) and len(set(label)) < len(texts) - 60


def test_bands_agree_as_the_jaccard_says():
    rng = np.random.default_rng(4)
    every = rng.integers(0, 1 << 64, (400, 100), dtype=np.uint64)
    pairs = [(np.sort(x[:90]), np.sort(x[10:])) for x in every]  # 80 of 100 in common
    a, b = (np.array(simhash.bands([p[k] for p in pairs])) for k in (0, 1))
    same = a == b
    assert abs(same.mean() - 0.8**simhash.MINIMA) < 0.02 and same.any(axis=1).all()
    assert simhash.bands([np.empty(0, np.uint64), pairs[0][0]]) == [[], a[0].tolist()] and simhash.bands([]) == []
    assert not (np.array(simhash.bands([x for x in every])) == np.array(simhash.bands([x + np.uint64(1) for x in every]))).any()


def repeats(w):
    c = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_quality_counts(docs, clash, none):
    got = {}
    for r in quality_rules.quality_rules(docs).collect():
        got[r.doc_id] = tuple(r)[1:7]
    for d, text, *_ in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, r = len(w), repeats(w)
        assert got[d] == (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n), d
    assert rows_of(quality_rules.quality_rules(clash)) == rows_of(quality_rules.quality_rules(docs))
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.keep_good(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}


def test_quality_limits_follow_the_group(spark):
    good = [(i, words(100, i) + f" #{'#' * (i % 3)}", "en", "noisy") for i in range(150)] + [(1000 + i, words(100, 500 + i), "en", "clean") for i in range(150)]
    odd = [(5000, words(100, 900) + " $" * 45, "en", "clean"), (5001, words(100, 901), "xx", "rare")]
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(good + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[r[0]] for r in good) and not out[5000] and out[5001]


def test_quality_limits_move_with_the_group(spark):
    """Every group has limits of its own: no part of them is fixed."""
    made = lambda k, n, marks, size: [(f"{'#' * marks(i)} " + words(100, 70_000 + 1000 * k + i)).replace("a", "a" * size) + ("\nx" * (i % 7) if k else "") for i in range(n)]
    rows = [("calm", t) for t in made(0, 500, lambda i: 0, 1)] + [("loud", t) for t in made(1, 500, lambda i: i % 30, 4)] + [("few", t) for t in made(2, 8, lambda i: i % 30, 4)]
    docs = spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    limits = {r["__pm_ts"]: r for r in quality_rules.thresholds(materialise(quality_rules.sketches(materialise(quality_rules.with_counts(docs), "counts")), "sketch")).collect()}
    for m in ("symbols", "word_length"):
        calm, few, loud = (limits[s][f"__pm_max_{m}"] for s in ("calm", "few", "loud"))
        assert len({calm, few, loud}) == 3, m


def test_sketches_add_up(spark):
    df = spark.createDataFrame([(i, words(60 + i % 50, i), "en", f"s{i % 2}") for i in range(80)], "doc_id long, text string, lang string, source string")
    counted = quality_rules.with_counts(df)
    whole = quality_rules.sketches(counted).groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    parts = quality_rules.sketches(counted.where("doc_id % 3 = 0")).union(quality_rules.sketches(counted.where("doc_id % 3 <> 0"))).groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    assert rows_of(whole) == rows_of(parts)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(400, 12)) * 0.4, 2)
    v[100:160] = v[0]
    rows = [(i, [float(x) for x in v[i]], "x") for i in range(400)] + [(3, [float(x) for x in v[3]], "y"), (900, None, ""), (901, [1.0, None] * 6, ""), (902, [float("nan")] * 12, ""), (903, [float("inf")] * 12, ""), (904, [0.5, 1.0], ""), (920, [0.5, 2.0], ""), (None, [1.0] * 12, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    vec = topk.quantised(table)
    got = defaultdict(list)
    for r in topk.exact_top_k(vec, "vec_id % 20 = 0", 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: np.floor(v[i] * 64).astype(int) for i in range(400)} | {904: np.array([32, 64]), 920: np.array([32, 128])}
    every = [*whole.items(), (3, whole[3])]  # vec_id 3 is there twice
    for q in [i for i in whole if i % 20 == 0]:
        best = sorted((-int(whole[q] @ c), i) for i, c in every if i != q and len(c) == len(whole[q]))[:20]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    empty = topk.quantised(table.limit(0))
    assert topk.exact_top_k(empty, "vec_id % 20 = 0").count() == 0 and topk.exact_top_k(vec, "false").count() == 0


def test_top_k_over_several_blocks(spark, monkeypatch):
    """Floors from the first block, rows that share a vec_id, and a query among its own copies."""
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = np.random.default_rng(9)
    v = rng.integers(-20, 21, size=(300, 8))
    ids = [i // 2 if i < 40 else i for i in range(300)]
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, vec array<long>")
    got = Counter(tuple(r) for r in topk.exact_top_k(vec, "vec_id % 10 = 0", 7).collect())
    want = Counter()
    for a, (q, x) in enumerate(zip(ids, v)):
        if q % 10 == 0:
            best = sorted((-int(x @ y), i) for b, (i, y) in enumerate(zip(ids, v)) if b != a)[:7]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert got == want


def test_threshold_stops_early_on_skewed_lists():
    v = np.zeros((4000, 4), np.int64)
    v[:, 0] = np.arange(4000)
    lists = topk.Lists(v, np.arange(4000))
    found = lists.best(np.array([3, 0, 0, 0]), -1, 5)
    assert lists.ids[found.rows].tolist() == [3999, 3998, 3997, 3996, 3995] and found.met < 200 and found.stopped


def test_threshold_ends_by_the_bound():
    """Searches end by the bound before the lists do; with spread axes they score a part only."""
    rng = np.random.default_rng(12)
    turn = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    v = np.round((rng.normal(size=(3000, 24)) * 200 * 0.6 ** np.arange(24)) @ turn + 50).astype(np.int64)
    lists = topk.Lists(v, np.arange(3000))
    met, stopped = [], 0
    for q in range(0, 3000, 60):
        got = lists.best(v[q], q, 10)
        order = [x for x in np.lexsort((np.arange(3000), -(v @ v[q]))) if x != q][:10]
        assert lists.ids[got.rows].tolist() == order and got.scores.tolist() == (v[order] @ v[q]).tolist()
        met.append(got.met)
        stopped += got.stopped
        floor = lists.best(v[q], q, 10, float(got.scores[-1]))
        assert floor.rows.tolist() == got.rows.tolist() and floor.met <= 3000
    assert stopped == len(met) and np.mean(met) < 2000


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_pii_base_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice("ab1.2@-+ 0(3)5x9") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize("text,kind,span", [("mail john [at] site [dot] com now", "email", "john [at] site [dot] com"), ("jane at example dot org", "email", "jane at example dot org"), ("іvan@exаmple.com", "email", "іvan@exаmple.com"), ("call plus four nine one seven one two three four five six seven eight!", "phone", "plus four nine one seven one two three four five six seven eight"), ("+１ (555) 123-4567 8", "phone", "+１ (555) 123-4567 8"), ("ping 10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1")])
def test_pii_disguises_map_back(text, kind, span):
    base, every = pii.find_spans(text)
    assert set(base) <= set(every) and (kind, span) in [(pii.KINDS[k], text[s:e]) for s, k, e in every]
    assert span not in pii.redact(text) and f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize("text", ["we meet at example.com", "at the dot", "one two or three of un deux", "(at) once", "a@b", ""])
def test_pii_leaves_prose_alone(text):
    assert pii.find_spans(text) == ([], []) and pii.redact(text) == text


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("ring plus 4 9 1 5 1 five 2 3 4 5 six 7 today", "plus 4 9 1 5 1 five 2 3 4 5 six 7"),
        ("ring +49 151 2345 six seven eight.", "+49 151 2345 six seven eight"),
        ("(plus four nine 151 2345 six 7 8; thanks)", "plus four nine 151 2345 six 7 8"),
        ("+49 (151) 2345 six 7 eight", "+49 (151) 2345 six 7 eight"),
    ],
)
def test_pii_few_written_digits(text, span):
    every = pii.find_spans(text)[1]
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in every] == [("phone", span)]


def test_pii_digit_names_in_addresses():
    text = "1985.one at example dot com"
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.find_spans(text)[1]] == [("email", text)]


HUGE = {"digits": "7" * 10**6, "dotted": "a." * 500_000, "dots": "a dot " * 170_000, "plain": "john.doe@example.org " * 50_000, "disguised": "john dot doe at example dot org, " * 31_250, "spaces": "a" + " " * 500_000 + "@" + " " * 500_000 + "b", "ats": "at dot " * 140_000, "numbers": "1.2.3.4." * 125_000, "names": "one " * 250_000, "brackets": "( " * 500_000, "bracketed": "x (at) " * 140_000}


@pytest.mark.parametrize("name", sorted(HUGE))
def test_pii_is_linear(name):
    start = time.process_time()
    base, every = pii.find_spans(HUGE[name])
    assert time.process_time() - start < 12
    assert len(every) == {"plain": 50_000, "disguised": 31_250, "numbers": 125_000}.get(name, 0)


def disguise(rng):
    """A text, and the kind and the place of what it disguises."""
    letters = lambda n: "".join(rng.choice("abcdehiklmnoprstuvwxyz") for _ in range(n))
    kind = rng.choice(("email", "email", "phone", "ip"))
    if kind == "email":
        at = rng.choice((" at ", " [at] ", "(at)", " {AT} ", " <at> ", " (@) ", " arroba "))
        dot = rng.choice((" dot ", " [dot] ", "(dot)", " (.) ", " punkt ", "[.]"))
        span = f"{letters(rng.randint(3, 8))}{rng.choice(('.', '_', '', dot))}{letters(rng.randint(3, 8))}{at}{letters(rng.randint(4, 9))}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"
        if rng.random() < 0.4:
            span = "".join(rng.choice([k for k, v in pii.GLYPHS.items() if v == c] or [c]) if rng.random() < 0.3 else c for c in span.replace(at, "@").replace(dot, "."))
    elif kind == "phone":
        digits = f"{rng.randint(1, 99)}{rng.randint(10**9, 10**10 - 1)}"
        names = rng.choice(pii._DIGIT_WORDS).split()
        style = rng.random()
        if style < 0.4:
            span = "plus " + " ".join(names[int(d)] for d in digits)
        elif style < 0.7:
            span = "+" + " ".join(names[int(d)] if rng.random() < 0.4 else d for d in digits)
        else:
            span = "+" + "".join(chr(0xFF10 + int(d)) if rng.random() < 0.6 else d for d in digits)
    else:
        span = rng.choice(("[.]", " dot ", "(dot)", " [dot] ")).join(str(rng.randint(0, 255)) for _ in range(4))
    before, after = (" ".join(letters(rng.randint(2, 7)) for _ in range(rng.randint(0, 6))) for _ in range(2))
    text = f"{before}: {span}; {after}"
    return text, kind, span


def test_pii_recall_of_disguises():
    rng = random.Random(31)
    found = total = 0
    for _ in range(2000):
        text, kind, span = disguise(rng)
        if any(text[s:e] == span for s, k, e in pii.base_spans(text)):
            continue  # not disguised after all
        total += 1
        found += any(pii.KINDS[k] == kind and text[s:e] == span for s, k, e in pii.find_spans(text)[1])
    print(f"{found} of {total} disguises found")
    assert total > 1500 and found >= 0.95 * total


def test_pii_lookalikes_are_whole():
    assert all(v == "" or v.isascii() for v in pii.GLYPHS.values()) and not any(map(str.isascii, pii.GLYPHS))
    text = "ivan.\u0458@example.org"
    assert [(k, text[s:e]) for s, k, e in pii.find_spans(text)[1]] == [(0, text)]


def test_pii_rows(docs, clash, none):
    got = pii.pii_spans(docs).collect()
    assert len(got) == len(ROWS) and rows_of(pii.pii_spans(clash)) == rows_of(pii.pii_spans(docs)) and pii.pii_spans(none).count() == 0
    r = next(r for r in got if r.doc_id == 16)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1)
    assert next(r for r in got if r.doc_id == 9).base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = pii.redact_texts(clash)
    assert masked.columns == clash.columns
    by = {r.doc_id: r for r in masked.collect()}
    assert "[EMAIL] [PHONE] or [IP]" in by[16].text and by[16].n_chars == len(by[16].text) and by[9].text is None


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokens.vocabulary_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


ODD = ["", "  a b", "a\tb c", "\n\n x\n", "it's\x1cfoo  bar ", "x <|endoftext|> y<|endoftext|>", "<|ENDOFTEXT|>", " ", "aaaaaaa aaaa", "abababab", "İ é é", "don't I'LL 1a2", "ǅ ﬁ ½", "!!!! ....", "end., (End) \"x\"", "ΑΣ Σ,"]


def soup(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeé ñ'.,!\n\tß漢Σ1٣½  <|A") for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name, libraries):
    enc = tokens.Encoder(tokens.vocabulary_path(name))
    for texts in (ODD + soup(1, 300), [words(200, 7), "", words(50, 8).title() + "!"]):
        ids, n = enc(texts)
        want = [e.ids for e in libraries[name].encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_pair_index_equals_the_library(libraries, docs, clash, none):
    lib = libraries["word_bpe_49k.json"]
    own = bpe.PairIndexBPE(tokens.vocabulary_path("word_bpe_49k.json"))
    texts = ODD + soup(2, 300) + ["a" * 300, "ab" * 200, words(300, 6)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    assert [own.decode(i) for i in want] == [lib.decode(i, skip_special_tokens=False) for i in want]
    got = bpe.encode_digests(docs).collect()
    by = {(r.doc_id, r.ids_sha256): r for r in got}
    for d, text, *_ in ROWS:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        r = by[d, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert rows_of(bpe.encode_digests(clash)) == rows_of(bpe.encode_digests(docs)) and bpe.encode_texts(none).count() == 0


def test_codes_give_any_id():
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 5000):
        ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 33, n).astype(np.uint64)).astype(np.uint32)
        codes = token_files.Codes(token_files.pack_codes(ids))
        assert len(codes) == n and codes.slice(0, n).tolist() == ids.tolist()
        for i in rng.integers(0, n, 60).tolist() if n else []:
            j = min(n, i + int(rng.integers(0, 700)))
            assert codes[i] == ids[i] and codes.slice(i, j).tolist() == ids[i:j].tolist()
    with pytest.raises(ValueError):
        token_files.Codes(b"none")


def test_token_files_read_back(spark, docs, clash, none, libraries, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 2000)
    path = tokens.vocabulary_path("word_bpe_49k.json")
    token_files.write_token_files(clash, path, str(tmp_path / "a"))
    got = token_files.read_token_files(spark, str(tmp_path / "a"), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    at = 0
    by = {r[0]: r[1] for r in ROWS}
    for r in got:
        want = libraries["word_bpe_49k.json"].encode(by[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.ids == want and r.start == at and r.n_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    token_files.write_token_files(none, path, str(tmp_path / "b"))
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_packing_covers_every_token_once(docs, clash, none, libraries):
    got = packing.best_fit_pack(clash, with_ids=True).collect()
    lib = libraries["byte_bpe_50k.json"]
    left = Counter((r[0], tuple(lib.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in ROWS)
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 2048
    long = sorted(parts[13], key=lambda r: r.piece)
    assert sum((r.ids for r in long), []) == lib.encode(LONG, add_special_tokens=False).ids + [0]
    assert all(r.length == 2048 for r in long[1:]) and [r.start for r in long] == [0, *np.cumsum([r.length for r in long])[:-1].tolist()]
    assert len(parts[12]) == 2 and sum(len(x) for x in parts.values()) == len(got) and sum(left.values()) == len(ROWS)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.best_fit_pack(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_each_piece_and_waste_little(seed):
    rng = np.random.default_rng(seed)
    limit = 64 if seed % 2 else 2048
    lengths = rng.integers(1, limit + 1, 3000) if seed < 4 else rng.choice([limit // 2 + 1, limit // 3, 5], 3000)
    counts = np.bincount(lengths, minlength=limit + 1)
    plan = packing.plan_sequences(counts, limit)
    used = np.zeros(limit + 1, dtype=int)
    for combo, times in plan:
        assert sum(combo) <= limit and times > 0
        for x in combo:
            used[x] += times
    assert used.tolist() == counts.tolist()
    opened: list[int] = []
    for x in sorted(lengths.tolist(), reverse=True):  # plain best fit decreasing
        fit = [k for k, g in enumerate(opened) if g >= x]
        if fit:
            k = min(fit, key=lambda k: opened[k])
            opened[k] -= x
        else:
            opened.append(limit - x)
    assert sum(t for _, t in plan) <= len(opened)


def test_plans_fill_with_pairs_and_triples():
    """On lengths like those of texts the full method is at the lower bound."""
    rng = np.random.default_rng(4)
    n = np.exp(rng.normal(6.2, 1.0, 6000)).astype(int) + 1
    count = -(-n // 2048)
    lengths = np.concatenate([np.full((count - 1).sum(), 2048), n - (count - 1) * 2048])
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.plan_sequences(counts)
    filled = Counter()
    for combo, times in plan:
        if sum(combo) == 2048:
            filled[len(combo)] += times
    assert sum(times for _, times in plan) <= -(-int(lengths.sum()) // 2048) + 1
    assert filled[2] and filled[3] > 20 and filled[4] > 20


def test_sum_index_finds_what_there_is():
    rng = np.random.default_rng(7)
    for _ in range(40):
        counts = rng.integers(0, 3, 31) * (rng.random(31) < 0.4)
        counts[0] = 0
        index = packing.SumIndex(counts, 30)
        base = int(rng.integers(1, 31))
        left = counts.copy()
        left[base] += 1  # one of them is the base
        index = packing.SumIndex(left, 30)
        stock = [x for x in range(1, 31) for _ in range(int(counts[x]))]
        for s in range(1, 31):
            for parts in (1, 2, 3):
                exists = any(sum(c) == s for c in itertools.combinations(stock, parts))
                got = index.find(left, base, s, parts)
                assert (got is not None) == exists and (got is None or sum(got) == s and len(got) == parts and not Counter(got) - Counter(stock))


def test_statistics_and_isotonic():
    assert quality_model.statistics("") == [0.0] * 20 and len(quality_model.statistics(LONG)) == 20
    at, value = quality_model.isotonic(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]))
    assert (np.diff(value) >= 0).all() and len(at) == 3


def labelled_docs(spark, n=700):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad, rude = rng.random() < 0.3, rng.random() < 0.4
        text = words(rng.randint(60, 200), 10_000 + i)
        parts = text.split()
        if rude:
            for _ in range(6):
                parts.insert(rng.randrange(len(parts)), rng.choice(("zugnork", "blerrkim", "zugnorki")))
        text = " ".join(w + "%%" if bad else w for w in parts)
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def learnt(spark):
    return labelled_docs(spark)


def accuracy(rows, labels, column):
    y = {r.doc_id: r[column] for r in labels.collect() if r[column] is not None}
    held = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert len(held) > 50
    return sum(p == t for p, t in held) / len(held)


def test_quality_scores(spark, learnt, clash, none):
    docs, labels = learnt
    rows = quality_model.quality_scores(docs, labels).collect()
    assert accuracy(rows, labels, "quality") > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.held_out} == {i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert quality_model.quality_scores(clash, labels).count() == len(ROWS)
    assert {r.score for r in quality_model.quality_scores(clash, labels.limit(0)).collect()} == {0.5}
    assert quality_model.quality_scores(none, labels).count() == 0


def test_toxicity_scores(spark, learnt, clash, none):
    docs, labels = learnt
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert accuracy(rows, labels, "toxic") > 0.9 and all(0 <= r.score <= 1 for r in rows)
    got = toxicity.toxicity_scores(clash, labels).collect()
    assert len(got) == len(ROWS) and {r.score for r in got if r.doc_id in (9, 10, 11)} == {0.0}
    assert toxicity.toxicity_scores(none, labels).count() == 0
    kept = toxicity.drop_toxic(clash, labels.limit(0))
    assert kept.columns == clash.columns and kept.count() == len(ROWS)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        starts = toxicity.window_starts(n)
        seen = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_odd_column_names_do_no_harm(spark, docs, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = {
        "simhash": simhash.simhash_groups, "rules": quality_rules.quality_rules, "pii": pii.pii_spans, "bpe": bpe.encode_digests,
        "quality": lambda d: quality_model.quality_scores(d, labels), "toxic": lambda d: toxicity.toxicity_scores(d, labels),
        "pack": lambda d: packing.best_fit_pack(d).select("doc_id", "piece", "start", "length", "ids_crc32"),
    }
    for name, f in same.items():
        assert rows_of(f(awkward)) == rows_of(f(docs)), name
    at = awkward.columns.index("doc_id")
    through = {"good": quality_rules.keep_good, "dedup": simhash.near_dedup, "mask": pii.redact_texts, "clean": lambda d: toxicity.drop_toxic(d, labels)}
    for name, f in through.items():
        got = f(awkward)
        assert got.columns == awkward.columns, name
        rows = [tuple(r) for r in got.collect()]
        assert all(r[:at] == ("no",) * at for r in rows), name
        assert sorted((r[at:] for r in rows), key=str) == rows_of(f(docs)), name


def test_windows_score_as_in_a_plain_loop():
    rng = np.random.default_rng(6)
    net = toxicity.Network(4)
    net.p = {k: rng.normal(size=v.shape).astype(np.float32) * 0.4 for k, v in net.p.items()}
    evidence = toxicity.Evidence.of([words(60, i) + (" zugnork" if i % 2 else "") for i in range(12)], [i % 2 for i in range(12)])
    texts = [words(n, 40 + n) for n in (1, 7, 32, 33, 90)] + [""]
    logits, count = toxicity.Reader(net.p, evidence).window_logits(texts)
    p, s = net.p, lambda x: 1 / (1 + np.exp(-x))
    got = iter(logits.tolist())
    for text, n in zip(texts, count.tolist()):
        ws = [toxicity.clean(w) for w in text.lower().split()]
        starts = toxicity.window_starts(len(ws))
        assert len(starts) == n
        for start in starts:
            rows = []
            for w in ws[start : start + toxicity.WINDOW]:
                inputs = toxicity.word_inputs([w])
                chars = np.mean([p["char"][c % toxicity.CHAR_BUCKETS] for c in inputs[1]], axis=0)
                rows.append(np.concatenate([p["word"][inputs[0][0] % toxicity.WORD_BUCKETS], chars, evidence.features(inputs)[0]]))
            states = {}
            for d in "fb":
                h, out = np.zeros(toxicity.HIDDEN), []
                for x in rows if d == "f" else rows[::-1]:
                    g, u = x @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
                    k = toxicity.HIDDEN
                    r, z = s(g[:k] + u[:k]), s(g[k : 2 * k] + u[k : 2 * k])
                    h = (1 - z) * np.tanh(g[2 * k :] + r * u[2 * k :]) + z * h
                    out.append(h)
                states[d] = out if d == "f" else out[::-1]
            both = np.array([np.concatenate(x) for x in zip(states["f"], states["b"])])
            e = np.exp(np.tanh(both @ p["A"]) @ p["a"])
            assert next(got) == pytest.approx(float((e / e.sum()) @ both @ p["w"] + p["bias"][0]), abs=2e-3)


def test_evidence_leaves_out_the_own_text():
    texts, labels = ["zug one", "zug two", "ab two", "ab three"], [1, 1, 0, 0]
    e = toxicity.Evidence.of(texts, labels)
    tell = lambda w, own=None: float(e.features(toxicity.word_inputs([w]), own)[0, 0])
    assert tell("zug") > tell("zug", 1) > 0 > tell("ab", 0) and tell("one", 1) == 0 and tell("two") == 0


def test_normal_equations_give_plain_ridge(spark):
    """The partition-summed solution is that of one matrix of all rows."""
    docs, labels = labelled_docs(spark, 260)
    model = quality_model.fit(docs, labels)
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    some = [(r.text, y[r.doc_id]) for r in docs.collect() if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 5]
    x = np.array([quality_model.statistics(t) for t, _ in some])
    assert np.allclose(model["mean"], x.mean(axis=0)) and np.allclose(model["std"], np.maximum(x.std(axis=0), 1e-3))
    z = quality_model._signal(x, model)
    beta = np.linalg.lstsq(np.vstack([z, np.sqrt(quality_model.RIDGE) * np.eye(z.shape[1])]), np.concatenate([[t for _, t in some], np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(model["beta"], beta, atol=1e-6)


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs = toxicity.word_inputs(["ab", "cde", "zz", "long"])
    index, mask = rng.integers(0, 4, (3, 5)), np.ones((3, 5))
    mask[0, 3:] = 0
    y, weight = np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        logit, _ = net.forward(net.gates(net.embed(inputs)), index, mask)
        return float((np.logaddexp(0, logit) - y * logit).mean())

    before = {k: v.copy() for k, v in net.p.items()}
    got = {}

    class Slow(dict):
        def __getitem__(self, k):
            got.setdefault(k, np.zeros_like(before[k]))
            return got[k]

        def __setitem__(self, k, v):
            got[k] = v

    net.slow = Slow()
    net.learn(inputs, index, mask, y, weight)
    net.p = before
    for k in ("Uf", "Ub", "Wf", "Wb", "cf", "A", "a", "w", "bias", "char", "word"):
        place = np.unravel_index(int(np.abs(got[k]).argmax()), got[k].shape)
        keep, eps = before[k][place], 1e-4
        before[k][place] = keep + eps
        up = loss()
        before[k][place] = keep - eps
        down = loss()
        before[k][place] = keep
        assert (up - down) / (2 * eps) == pytest.approx(got[k][place] * 10, rel=0.05, abs=1e-5), k


SCHEMAS = {"find": {"q": {"type": "string", "required": True, "minLength": 1}, "n": {"type": "integer", "minimum": 1, "maximum": 9}}}


def test_tool_calls(spark):
    call = lambda i, name, args, after=(): {"id": i, "name": name, "arguments": args, "after": list(after)}
    messages = [
        (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"tool_calls": [call("b", "find", {"q": "x", "n": 3}, ["a"]), call("a", "find", {"n": 0, "q": ""})]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": 'say "é"'})), (1, 3, "assistant", json.dumps({"tool_calls": [call("c", "other", {}, ["b", "zz"]), call("d", "find", {"q": 5, "extra": 1}, ["e"]), call("e", "find", {"q": "y"}, ["d"])]})),
        (1, 4, "tool", json.dumps({"tool_call_id": "lost", "content": "?"})), (2, 0, "assistant", "plain text"), (2, 1, "tool", None), (None, 1, "assistant", json.dumps({"tool_calls": [call("n", "find", {})]})),
        (1, 5, "tool", json.dumps({"tool_call_id": "b", "content": "late"})),
    ]
    table = spark.createDataFrame([(*m, "x") for m in messages], "conv_id long, turn long, role string, text string, level string")
    got = {r.call_id: r for r in tool_calls.link_tool_calls(*tool_calls.calls_and_results(table), SCHEMAS).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", "lost"}
    assert {k: (r.level, r.status) for k, r in got.items()} == {"a": (0, "unanswered"), "b": (1, "answered"), "c": (2, "unanswered"), "d": (None, "unanswered"), "e": (None, "unanswered"), "lost": (None, "orphan")}
    assert [k for k, r in sorted(got.items(), key=lambda x: x[1].position or 99)] == ["a", "b", "c", "d", "e", "lost"]
    assert {k: r.errors for k, r in got.items()} == {"a": "minLength:q,minimum:n", "b": "", "c": "tool:*", "d": "extra:*,type:q", "e": "", "lost": None}
    assert got["b"].call_json == '{"arguments":{"n":3,"q":"x"},"id":"b","name":"find","role":"assistant"}' and got["b"].n_results == 2
    assert json.loads(got["b"].result_json) == {"content": 'say "é"', "id": "b", "role": "tool"}
    empty = table.limit(0)
    assert tool_calls.link_tool_calls(*tool_calls.calls_and_results(empty), SCHEMAS).count() == 0


def test_tool_calls_with_repeated_identifiers(spark):
    call = lambda i, q, after=(): json.dumps({"tool_calls": [{"id": i, "name": "find", "arguments": {"q": q}, "after": list(after)}]})
    result = lambda i, content: json.dumps({"tool_call_id": i, "content": content})
    messages = [
        (1, 1, "assistant", call("call_0", "one")), (1, 2, "tool", result("call_0", "r1")), (1, 3, "assistant", call("call_1", "two", ["call_0"])),
        (1, 5, "assistant", call("call_0", "three", ["call_1"])), (1, 6, "tool", result("call_0", "r3")), (1, 7, "tool", result("call_0", "again")),
        (2, 1, "assistant", call("call_0", "four")), (3, 1, "tool", result("call_0", "lone")), (4, 1, "assistant", call("call_0", "five")), (4, 2, "tool", result("call_0", "r5")),
        (5, 1, "assistant", call("x", "six")), (5, 1, "assistant", call("x", "seven")), (5, 2, "tool", result("x", "a")), (5, 2, "tool", result("x", "b")),
    ]
    table = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = tool_calls.link_tool_calls(*tool_calls.calls_and_results(table), SCHEMAS).collect()
    q = lambda r: r.call_json and json.loads(r.call_json)["arguments"]["q"]
    content = lambda r: r.result_json and json.loads(r.result_json)["content"]
    assert sorted(((r.conv_id, r.call_id, r.status, r.level, q(r), content(r), r.n_calls, r.n_results) for r in got), key=str) == sorted([
        (1, "call_0", "answered", 0, "one", "r1", 2, 3), (1, "call_1", "unanswered", 1, "two", None, 1, 0), (1, "call_0", "answered", 2, "three", "r3", 2, 3), (1, "call_0", "extra", None, None, "again", 2, 3),
        (2, "call_0", "unanswered", 0, "four", None, 1, 0), (3, "call_0", "orphan", None, None, "lone", 0, 1), (4, "call_0", "answered", 0, "five", "r5", 1, 1),
        (5, "x", "answered", 0, "seven", "a", 2, 2), (5, "x", "answered", 0, "six", "b", 2, 2),
    ], key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5), (None, 3), (7000, 7001), (7000, 7001)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + k: 1000 for k in range(50)} | {7000: 7000, 7001: 7000}
    assert got == want
