"""Quality rules with thresholds learnt from mergeable quantile sketches; DataFrame functions only.

The sketch of a metric is a histogram over whole per mille with seven significant bits (as in
high-dynamic-range histograms): bins of a fixed relative width under 1/64, so that sketches of
parts add up to the sketch of the whole, in any order, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, by_place, discard, docs_of, materialise, pick

_BLANK = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: A group's sketch is blended with its language's, and that with the sketch of all, as if the
#: wider one were this many documents of the group.
PRIOR = 400
#: metric -> (numerator, denominator, two quantiles, multiple, whether the numerator counts rare
#: events). The limit is the higher quantile and that multiple of its distance from the lower one.
METRICS = {
    "symbols": ("n_symbols", "n_words", 0.90, 0.50, 4, True),
    "dup_lines": ("n_dup_lines", "n_lines", 0.99, 0.90, 2, True),
    "repeats": ("n_repeat_words", "n_words", 0.99, 0.90, 3, True),
    "word_length": ("word_chars", "n_words", 0.90, 0.50, 4, False),
}
#: Cumulative shares are whole numbers out of this.
_ONE = 10_000_000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, prefix: str = "", text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Three-word windows are compared by a 64-bit hash within one text. All work stays within
    the row, so no text is shuffled.
    """
    t = lambda name: f"__pm_{name}"
    step = docs.withColumn(t("t"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    step = step.withColumn(t("w"), F.split(F.btrim(t("t"), F.lit(_BLANK)), WS))
    step = step.withColumns(
        {
            t("n"): F.when(F.btrim(t("t"), F.lit(_BLANK)) == "", F.lit(0)).otherwise(F.size(t("w"))),
            t("l"): F.filter(F.split(t("t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    w = F.col(t("w"))
    windows = F.transform(F.sequence(F.lit(0), F.col(t("n")) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    step = step.withColumn(t("h"), F.when(F.col(t("n")) >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct(t("h"))) < F.size(t("h"))
    sorted_pairs = F.sort_array(F.transform(F.col(t("h")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn(t("s"), F.when(again, sorted_pairs))
    s = F.col(t("s"))
    twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    step = step.withColumn(t("p"), F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col(t("p"))
    steps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(p.isNull() | (F.size(p) == 0), F.lit(0)).otherwise(F.lit(3) + F.aggregate(steps, F.lit(0), lambda acc, x: acc + x))
    made = {
        "n_words": F.col(t("n")),
        "word_chars": F.when(F.col(t("n")) == 0, F.lit(0)).otherwise(F.length(F.array_join(t("w"), ""))),
        "n_symbols": F.length(F.regexp_replace(t("t"), r"[^#*$%&|<>]+", "")),
        "n_lines": F.size(t("l")),
        "n_dup_lines": F.size(t("l")) - F.size(F.array_distinct(t("l"))),
        "n_repeat_words": covered,
    }
    return step.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.cast("long").alias(prefix + n) for n, c in made.items()])


def _failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > 50 * n)


def _rate(metric: str, prefix: str = "") -> Column:
    """The metric in whole per mille."""
    up, down, *_ = METRICS[metric]
    return F.expr(f"(1000 * `{prefix}{up}`) div greatest(`{prefix}{down}`, 1L)")


def _within(metric: str, up: str, down: str, limit: str, number: str) -> str:
    """SQL: whether a text keeps to the limit (per mille).

    A short text's rate of rare events is uncertain, so up to three standard deviations of a
    Poisson count (of the expected number and one) above the limit are let pass.
    """
    if not METRICS[metric][5]:
        return f"1000 * {up} <= {limit} * greatest({down}, 1)"
    over = f"CAST(1000 * {up} - {limit} * {down} AS {number})"
    return f"({over} <= 0 OR {over} * {over} <= 9000 * CAST({limit} * {down} + 1000 AS {number}))"


def sketches(counted: DataFrame, prefix: str = "") -> DataFrame:
    """(lang, source, metric, bin, n): the sketch of each metric over rows that pass the base."""
    rates = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _rate(m, prefix).alias("v")) for m in METRICS])).alias("m")
    rows = counted.where(~_failed(prefix)).select(F.col(f"{prefix}lang").alias("lang"), F.col(f"{prefix}source").alias("source"), rates)
    cut = F.expr("greatest(length(bin(m.v)) - 7, 0)")
    binned = rows.select("lang", "source", "m.metric", F.call_function("shiftright", F.col("m.v"), cut).alias("k"), cut.alias("c"))
    return binned.groupBy("lang", "source", "metric", F.expr("shiftleft(k, c)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _shares(cumulative: DataFrame, wider: DataFrame | None, keys: list[str]) -> DataFrame:
    """(*keys, metric, bin, share): cumulative shares of a sketch, blended with the wider one's.

    ``cumulative(*keys, metric, bin, seen, docs)`` has a row for every bin of the wider sketch,
    ``wider(*keys but the last, metric, bin, wide)``.
    """
    if wider is None:
        return cumulative.select("metric", "bin", F.expr(f"(seen * {_ONE}L) div docs").alias("share"))
    return cumulative.select(*keys, "metric", "bin", F.expr(f"(seen * {_ONE}L + wide * {PRIOR}L) div (docs + {PRIOR}L)").alias("share"))


def _grid(sketch: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, metric, bin, wide, seen, docs): each group's counts on all bins of the wider sketch.

    A metric has some hundred bins at most, so a group has a bounded number of rows.
    """
    groups = sketch.select(*keys).distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m in METRICS])))
    outer = [*keys[:-1], "metric"]
    bins = wider.select(*[F.col(c).alias(f"w_{c}") for c in outer], "bin", F.col("share").alias("wide"))
    every = groups.join(bins, _same(outer, [f"w_{c}" for c in outer])).select(*keys, "metric", "bin", "wide")
    own = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n")).select(*[F.col(c).alias(f"o_{c}") for c in (*keys, "metric", "bin")], "n")
    both = every.join(own, _same([*keys, "metric", "bin"], [f"o_{c}" for c in (*keys, "metric", "bin")]), "left")
    by = Window.partitionBy(*keys, "metric")
    n = F.coalesce("n", F.lit(0))
    return both.select(*keys, "metric", "bin", "wide", F.sum(n).over(by.orderBy("bin")).alias("seen"), F.sum(n).over(by).alias("docs"))


def _same(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, a limit in per mille for each metric), as columns ``__pm_*``.

    The quantiles are read off the pair's sketch, blended with that of its language, which is
    blended with that of all: a large group goes by its own documents, a small one by its wider
    group's, without a step between them.
    """
    merged = sketch.groupBy("metric", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("metric")
    every = _shares(merged.select("metric", "bin", F.sum("n").over(by.orderBy("bin")).alias("seen"), F.sum("n").over(by).alias("docs")), None, [])
    lang = _shares(_grid(sketch, every, ["lang"]), every, ["lang"])
    pair = _shares(_grid(sketch, lang, ["lang", "source"]), lang, ["lang", "source"])
    out = []
    for m, (_, _, high, low, times, _) in METRICS.items():
        q = lambda p, m=m: F.min(F.when((F.col("metric") == m) & (F.col("share") >= round(p * _ONE)), F.col("bin")))
        out.append((q(high) + times * (q(high) - q(low))).cast("long").alias(f"__pm_max_{m}"))
    return pair.groupBy(F.col("lang").alias("__pm_tl"), F.col("source").alias("__pm_ts")).agg(*out)


def judged(counted: DataFrame, prefix: str = "") -> DataFrame:
    """``counted`` (a stored table) with base_failed and kept.

    Thresholds are stored first, so their size is known: Spark sends them to all tasks while
    they are below its limit, and shuffles (and splits a common source's rows) only beyond it.
    """
    sketch = materialise(sketches(counted, prefix), "sketch")
    limits = materialise(thresholds(sketch), "limits")
    discard(counted.sparkSession, sketch)
    within = F.lit(True)
    for m, (up, down, *_) in METRICS.items():
        within = within & F.expr(_within(m, f"`{prefix}{up}`", f"`{prefix}{down}`", f"__pm_max_{m}", "DOUBLE"))
    on = F.col(f"{prefix}lang").eqNullSafe(F.col("__pm_tl")) & F.col(f"{prefix}source").eqNullSafe(F.col("__pm_ts"))
    joined = counted.join(limits, on, "left")
    return joined.select(*[F.col(f"`{c}`") for c in counted.columns], _failed(prefix).alias(f"{prefix}base_failed"), (~_failed(prefix) & F.coalesce(within, F.lit(False))).alias(f"{prefix}kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept) of every row of ``docs``.

    Null and empty texts have no words and fail the base. Null languages and sources are groups
    of their own. Null doc_ids and repeated rows pass through; an empty table gives no rows;
    other columns are ignored.
    """
    rows = with_counts(pick(docs, doc_id="long", lang="string", source="string", text="string")).drop("text")
    return judged(materialise(rows, "quality")).select("doc_id", *_COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Null and empty texts have no words and are dropped; null languages and sources are groups of
    their own; null doc_ids and repeated rows are judged like any other; an empty table stays
    empty. Columns of any name pass through, absent ones count as null.
    """
    placed, at = by_place(docs)
    p = "__pm_q_"
    given = {f"{p}{c}": (F.col(at[c]) if c in at else F.lit(None)).cast("string") for c in ("lang", "source", "text")}
    counted = materialise(with_counts(placed.withColumns(given), p, f"{p}text").drop(f"{p}text"), "kept")
    return judged(counted, p).where(f"{p}kept").select(*placed.columns).toDF(*docs.columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(docs_of(spark, sf_dir))


def _oracle() -> str:
    rate = {m: f"(1000 * {up}) // greatest({down}, 1)" for m, (up, down, *_) in METRICS.items()}
    bins = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {rate[m]} AS v FROM counted WHERE NOT base_failed" for m in METRICS)

    def blended(name: str, wide: str, keys: list[str]) -> str:
        own, outer = "".join(f"{k}, " for k in keys), [*keys[:-1], "metric"]
        same = lambda a, b, cols: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)
        return f"""{name}_n AS (SELECT {own}metric, bin, sum(n) AS n FROM sketch GROUP BY ALL),
{name}_k AS (SELECT DISTINCT {own}m.metric FROM sketch, (SELECT DISTINCT metric FROM sketch) m),
{name}_g AS (SELECT {''.join(f'k.{c}, ' for c in keys)}k.metric, w.bin, w.share AS wide, coalesce(o.n, 0) AS n FROM {name}_k k JOIN {wide} w ON {same('k', 'w', outer)}
  LEFT JOIN {name}_n o ON {same('k', 'o', [*keys, 'metric'])} AND o.bin = w.bin),
{name} AS (SELECT {own}metric, bin, (sum(n) OVER (PARTITION BY {own}metric ORDER BY bin) * {_ONE} + wide * {PRIOR}) // (sum(n) OVER (PARTITION BY {own}metric) + {PRIOR}) AS share FROM {name}_g)"""

    q = lambda m, p: f"min(CASE WHEN metric = '{m}' AND share >= {round(p * _ONE)} THEN bin END)"
    limits = ", ".join(f"{q(m, high)} + {times} * ({q(m, high)} - {q(m, low)}) AS max_{m}" for m, (_, _, high, low, times, _) in METRICS.items())
    within = " AND ".join(_within(m, up, down, f"max_{m}", "DOUBLE") for m, (up, down, *_) in METRICS.items())
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1) AS i FROM t),
g AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, w, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AS twice FROM g),
v AS (SELECT rid, w, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered FROM c WINDOW o AS (PARTITION BY rid ORDER BY i)),
a AS (SELECT rid, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, count(*) FILTER (covered) AS n_repeat_words FROM v GROUP BY rid),
k AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
counted AS (SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_words, 0) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed
  FROM t LEFT JOIN a USING (rid) JOIN k USING (rid)),
r AS ({bins}),
sketch AS (SELECT lang, source, metric, (v >> CAST(greatest(length(bin(v)) - 7, 0) AS BIGINT)) << CAST(greatest(length(bin(v)) - 7, 0) AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY ALL),
every AS (SELECT metric, bin, (sum(n) OVER (PARTITION BY metric ORDER BY bin) * {_ONE}) // sum(n) OVER (PARTITION BY metric) AS share FROM (SELECT metric, bin, sum(n) AS n FROM sketch GROUP BY ALL)),
{blended('langs', 'every', ['lang'])},
{blended('pairs', 'langs', ['lang', 'source'])},
limits AS (SELECT lang, source, {limits} FROM pairs GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({within}, false) AS kept
FROM counted LEFT JOIN limits l ON counted.lang IS NOT DISTINCT FROM l.lang AND counted.source IS NOT DISTINCT FROM l.source
"""


OP3_SQL = _oracle()
