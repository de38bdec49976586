"""The search engine: an index over pages, and searches as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, rank, words
from .plans.compile import evaluate, looked_up
from .plans.query import Both, QueryError, parse
from .plans.query import words as leaves_of


@dataclass
class Found:
    """hits, pages and docs of a search, words of the query, and why it could not be read."""

    hits: DataFrame | None = None
    pages: DataFrame | None = None
    docs: DataFrame | None = None
    words: tuple[str, ...] = ()
    error: str | None = None


class Engine:
    """An index and its searches; a document is known by its source and name."""

    def __init__(self, pages: DataFrame | None = None, postings: DataFrame | None = None, stops: tuple[str, ...] = (), stems: bool = True, vocabulary: DataFrame | None = None, dictionary: DataFrame | None = None):
        self.pages, self.postings, self.stops, self.stems, self.vocabulary = pages, postings, stops, stems, vocabulary
        self.dictionary = dictionary if dictionary is not None or postings is None else index.dictionary(postings)

    @classmethod
    def build(cls, pages: DataFrame, stops: tuple[str, ...] = (), stems: bool = True, vocabulary: DataFrame | None = None, prepare: Callable[[Column], Column] | None = None) -> Engine:
        return cls(pages, index.postings(pages, list(stops), stems, vocabulary, prepare), tuple(stops), stems, vocabulary)

    def save(self, path: str) -> None:
        """Postings and dictionary by ranges of terms, pages, stop words and vocabulary as tables."""
        index.save(self.postings, f"{path}/postings")
        spark = self.pages.sparkSession
        stored = index.dictionary(index.load(spark, f"{path}/postings"))
        stored.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dictionary")
        self.pages.write.mode("overwrite").parquet(f"{path}/pages")
        spark.createDataFrame([(w,) for w in self.stops], "word string").coalesce(1).write.mode("overwrite").parquet(f"{path}/stops")
        empty = spark.createDataFrame([], "stem string, grp int")
        (empty if self.vocabulary is None else self.vocabulary).write.mode("overwrite").parquet(f"{path}/vocabulary")

    @classmethod
    def load(cls, spark: SparkSession, path: str, stops: tuple[str, ...] | None = None, stems: bool = True) -> Engine:
        """What ``save`` stored; ``stops``, if given, replace the stored ones."""
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        words_ = tuple(r["word"] for r in read("stops").orderBy("word").collect()) if stops is None else stops
        voc = read("vocabulary")
        return cls(read("pages"), index.load(spark, f"{path}/postings"), words_, stems, None if voc.isEmpty() else voc, read("dictionary"))

    def hits(self, tree, dist: int = 255, symmetric: bool = False) -> DataFrame:
        found = looked_up(self.dictionary, leaves_of(tree), self.stems, symmetric, self.vocabulary)
        return evaluate(self.postings, found, tree, dist)

    def field_hits(self, key: str, tree, dist: int = 255) -> DataFrame:
        """Hits in the header page of ``tree``, whose words carry the key of their field."""
        return self.hits(tree, dist)

    def search(self, request: str, dist: int = 255, compat: bool = False, symmetric: bool = False) -> Found:
        """Search as the query language says.

        Several fields must be near each other in the header page. ``compat`` orders documents
        upward by rank, caps pages and documents in the order of names before the ranking, and
        leaves pages of documents that a field rules out; otherwise the best come first and
        pages follow their documents.
        """
        if self.postings is None:
            return Found(error="Index is not built")
        try:
            q = parse(request, set(self.stops))
        except QueryError as problem:
            return Found(error=f"Syntax Error in search request: {problem}")
        keys = index.doc_keys(self.postings)
        named: DataFrame | None = None
        if q.fields:
            tree = reduce(Both, [tree for _, tree in q.fields])
            named = self.hits(tree, dist).select(*keys).distinct()
        if q.body is None:
            hits = named.select(*keys, F.lit(0).alias("page_no"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("coord"), F.lit(0).cast("long").alias("mask"))
        else:
            hits = self.hits(q.body, dist, symmetric)
        pages = rank.page_ranks(hits)
        if compat:
            pages = rank.cap_pages(pages)
        inside = pages if named is None else pages.join(named, keys, "left_semi")
        if q.doc_filters:
            full = F.concat_ws(":", *keys)
            inside = inside.where(F.array_contains(F.array(*[full.rlike(p) for p in q.doc_filters]), True))
        docs = rank.top_docs(rank.doc_ranks(inside), compat=compat)
        names = tuple(w.text for w in leaves_of(q.body)) if q.body is not None else ()
        return Found(hits, pages if compat else inside, docs, names)

    def documents(self, found: Found, compat: bool = False) -> DataFrame:
        """The documents of a search in full.

        source, doc, rank, n_pages, headers (a map), pages (an array of page_no, rank, positions
        and marked text, in page order), summary and found_words. Only pages of the documents
        that are shown, a bounded number, are joined with their texts.
        """
        keys = index.doc_keys(self.postings)
        docs = F.broadcast(found.docs)
        shown = rank.snippets(found.pages.join(docs.select(*keys), keys, "left_semi"), self.pages)
        listed = shown.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page_no", "rank", "positions", "text"))).alias("pages"))
        head = rank.headers(self.pages.join(docs.select(*keys), keys, "left_semi"))
        told = rank.summaries(shown, lowest=compat, by_id=compat)
        return found.docs.join(head, keys, "left").join(listed, keys, "left").join(told, keys, "left")

    def json(self, found: Found) -> DataFrame:
        """One row: {"found": number, "result": [documents]}, as the service answers."""
        full = self.documents(found)
        each = F.struct(F.round("rank", 6).alias("rank"), *index.doc_keys(self.postings), "n_pages", F.to_json("headers").alias("headers"), "pages", "summary", "found_words")
        body = F.to_json(F.struct(F.count(F.lit(1)).alias("found"), F.sort_array(F.collect_list(each), asc=False).alias("result")))
        return full.agg(body.alias("response"))

    def suggest(self, request: str, n: int = 10) -> DataFrame:
        return words.suggest(self.dictionary, request, n)

    def close_words(self, word: str, n: int = 10) -> DataFrame:
        return words.close_words(self.dictionary, word, n)
