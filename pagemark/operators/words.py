"""Dictionary tools: suggestions, close words, histogram, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..shared import cut


def suggest(dictionary: DataFrame, request: str, n: int = 10) -> DataFrame:
    """(suffix, n_postings): how the request's last word goes on, most frequent first."""
    last = request.lower().split()[-1] if request.split() else ""
    rows = dictionary.where((F.col("kind") == "form") & F.col("term").startswith(last) & (F.length("term") > len(last)) & F.lit(len(last) >= 2))
    return rows.orderBy(F.desc("n_postings"), "term").limit(n).select(F.substring("term", len(last) + 1, 1 << 20).alias("suffix"), "n_postings")


def close_words(dictionary: DataFrame, word: str, n: int = 10) -> DataFrame:
    """(term, distance): the forms with the least edit distance."""
    rows = dictionary.where("kind = 'form'").select("term", F.levenshtein("term", F.lit(word)).alias("distance"))
    return rows.orderBy("distance", "term").limit(n)


def histogram(dictionary: DataFrame, total: Column | int, n: int = 1000) -> DataFrame:
    """(term, n_postings, share of the total length in per mille): the most frequent forms."""
    rows = dictionary.where("kind = 'form'").orderBy(F.desc("n_postings"), "term").limit(n)
    return rows.select("term", "n_postings", (F.col("n_postings") * 1000.0 / total).alias("per_mille"))


def freeling(spark: SparkSession, folder: str) -> DataFrame:
    """lemmas(word, lemma) from lists whose lines begin with a form and its lemma."""
    parts = F.split("value", " ")
    rows = spark.read.text(folder).select(F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(1)).alias("lemma"))
    return rows.where("word <> '' AND lemma <> ''").select(F.lower("word").alias("word"), F.lower("lemma").alias("lemma"))


def opencorpora(spark: SparkSession, path: str) -> DataFrame:
    """lemmas(word, lemma) from a dictionary in XML: the ``t`` of each lemma and of its forms."""
    shape = "l struct<_t: string>, f array<struct<_t: string>>"
    rows = spark.read.format("xml").option("rowTag", "lemma").schema(shape).load(path).where("l._t IS NOT NULL")
    every = rows.select(F.col("l._t").alias("lemma"), F.explode(F.concat(F.array("l._t"), F.coalesce(F.col("f._t"), F.array().cast("array<string>")))).alias("word"))
    return every.where("word IS NOT NULL").select(F.lower("word").alias("word"), F.lower("lemma").alias("lemma"))


def numbered(roots: DataFrame) -> DataFrame:
    """(stem, grp) from (stem, root): groups counted from 1 by their root.

    Roots are as few as the words of a language, so one task may number them.
    """
    numbers = roots.select("root").distinct().withColumn("grp", F.row_number().over(Window.orderBy("root")))
    return roots.join(numbers, "root").select("stem", "grp")


def group_members(vocabularies: DataFrame, code: str, most: int = 20) -> str:
    """The first stems of a group ``#HEX``, with commas between; the high byte is the vocabulary."""
    n = int(code.removeprefix("#"), 16)
    rows = vocabularies.where((F.col("grp") == n & 0xFFFFFF) & (F.col("voc_no") == n >> 24) if "voc_no" in vocabularies.columns else F.col("grp") == n)
    return ",".join(r["stem"] for r in rows.orderBy("stem").limit(most).collect())


def vocabulary(lemmas: DataFrame, stems: bool = True) -> DataFrame:
    """(stem, root) from ``lemmas(word, lemma)``: groups that share a stem are one.

    root is the smallest stem of a group. Smallest labels are passed along until
    nothing changes; rounds grow with the longest chain of groups, short in real lists.
    """
    both = lemmas.select("lemma", F.explode(F.array("word", "lemma")).alias("w")).distinct()
    key = F.coalesce(stem(F.col("w")), F.col("w")) if stems else F.col("w")
    edges = cut(both.select(F.col("lemma").alias("g"), key.alias("s")).distinct())
    labels = edges.select("s", F.col("s").alias("label")).distinct()
    changed = 1
    while changed:
        low = edges.join(labels, "s").groupBy("g").agg(F.min("label").alias("low"))
        new = cut(edges.join(low, "g").groupBy("s").agg(F.min("low").alias("new")))
        changed = new.join(labels, "s").where("new <> label").count()
        labels = new.select("s", F.col("new").alias("label"))
    return labels.select(F.col("s").alias("stem"), F.col("label").alias("root"))
