"""Sources: everything becomes ``pages(source, doc, page_no, page_id, text)``.

Page 0 holds the header lines ``Key=Value``; body pages count from 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PAGE_CHARS, cut_pages, html_author, html_text, html_title



def _beside_latin(name: str) -> tuple[str, str]:
    """Characters of Latin-1, and what their bytes mean in the code page ``name``."""
    pairs = [(chr(b), bytes([b]).decode(name, "ignore")) for b in range(0x80, 0x100)]
    return tuple("".join(x) for x in zip(*[(a, b) for a, b in pairs if b and a != b]))


_CP1252, _CP1251 = _beside_latin("cp1252"), _beside_latin("cp1251")
SCHEMA = "source string, doc string, page_no int, page_id string, text string"


def header(pairs: dict[str, Column]) -> Column:
    """Lines ``Key=Value`` of the values that are not null; line breaks and = become spaces."""
    lines = [F.concat(F.lit(f"{k}="), F.regexp_replace(v.cast("string"), r"[\n\r=]", " "), F.lit("\n")) for k, v in pairs.items()]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in lines])


def _paged(rows: DataFrame, bodies: Column, size: int = PAGE_CHARS) -> DataFrame:
    """rows(source, doc, head, ...) with an array of body pages, to pages; one scan, no shuffle.

    All body pages but the last have ``size`` characters, so each page's start in the document
    is known here.
    """
    every = rows.select("source", "doc", F.length("head").alias("first"), F.posexplode(F.concat(F.array("head"), bodies)).alias("page_no", "text"))
    start = F.when(F.col("page_no") == 0, F.lit(0)).otherwise(F.col("first") + (F.col("page_no") - 1) * size).cast("long")
    return every.select("source", "doc", "page_no", F.col("page_no").cast("string").alias("page_id"), "text", start.alias("start"))


def from_rows(df: DataFrame, source: str, key: str, text: str | None, headers: list[str], size: int | None = PAGE_CHARS) -> DataFrame:
    """One document a row: ``key`` names it, the other columns are headers; null values drop."""
    pairs = {"Name": F.col(key), "Source": F.lit(source), **{h: F.col(h) for h in headers if h != text}}
    rows = df.select(F.lit(source).alias("source"), F.col(key).cast("string").alias("doc"), header(pairs).alias("head"), (F.coalesce(F.col(text).cast("string"), F.lit("")) if text else F.lit("")).alias("body"))
    bodies = F.array().cast("array<string>") if not text else cut_pages(F.col("body"), size) if size else F.array("body")
    return _paged(rows, bodies, size or PAGE_CHARS)


def from_pages(df: DataFrame, source: str, doc: str, page: str, text: str) -> DataFrame:
    """Documents whose pages are rows already; a header page is added to each."""
    body = df.select(F.lit(source).alias("source"), F.col(doc).cast("string").alias("doc"), (F.col(page) + 1).cast("int").alias("page_no"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    head = body.select("source", "doc").distinct().select("source", "doc", F.lit(0).alias("page_no"), header({"Name": F.col("doc"), "Source": F.col("source")}).alias("text"))
    return body.union(head).select("source", "doc", "page_no", F.col("page_no").cast("string").alias("page_id"), "text")


def from_html(df: DataFrame, source: str, url: str, html: str) -> DataFrame:
    """One page of visible text for each address; pages without text are left out."""
    rows = df.select(F.lit(source).alias("source"), F.col(url).alias("doc"), F.col(html).alias("h"))
    rows = rows.select("source", "doc", html_text(F.col("h")).alias("body"), header({"Name": F.col("doc"), "Source": F.col("source"), "Title": html_title(F.col("h")), "Author": html_author(F.col("h"))}).alias("head")).where("body <> ''")
    return _paged(rows, F.array("body"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 by its mark, UTF-8, else Windows-1251 if most letters are Cyrillic there, else Windows-1252."""
    mark, plain = F.hex(F.substring(content, 1, 2)), content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    high, low = F.length(F.regexp_replace(latin, "[^\u00c0-\u00ff]+", "")), F.length(F.regexp_replace(latin, "[^A-Za-z]+", ""))
    return (
        F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(plain), F.regexp_replace(plain, "^\ufeff", ""))
        .when(high > low, F.translate(latin, *_CP1251))
        .otherwise(F.translate(latin, *_CP1252))
    )


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    globs = "{" + ",".join(p.strip() for p in pattern.split(";") if p.strip()) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(root)


def _name(root: str) -> Column:
    """A file's path below ``root``."""
    bare = root.split("://")[-1].rstrip("/") + "/"
    return F.expr("substr(path, instr(path, {0}) + {1})".format("'" + bare.replace("\\", "\\\\").replace("'", "\\'") + "'", len(bare)))


def _sidecars(spark: SparkSession, root: str, docs: DataFrame) -> DataFrame:
    """(doc, extra, named): header lines from ``<file>.dscr`` and the ``.dscr`` of the folders above.

    Of equal keys the nearest file's counts; in a file, what follows a key that was there before
    is not read. ``named`` are the keys.
    """
    side = _files(spark, root, "*.dscr").select(_name(root).alias("at"), F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("n", "line"))
    side = side.where("line NOT LIKE ';%' AND line LIKE '%=%'").select("at", "n", F.substring_index("line", "=", 1).alias("k"), F.expr("substr(line, instr(line, '=') + 1)").alias("v"))
    again = F.row_number().over(Window.partitionBy("at", "k").orderBy("n")) > 1
    over = F.max(F.col("again").cast("int")).over(Window.partitionBy("at").orderBy("n"))
    side = side.withColumn("again", again).withColumn("over", over).where("over = 0").select("at", "n", "k", "v")
    parts = F.split("doc", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.concat_ws("/", F.slice(parts, 1, d), F.lit(".dscr")))
    places = docs.select("doc", F.posexplode(F.concat(above, F.array(F.concat("doc", F.lit(".dscr"))))).alias("depth", "at"))
    found = places.join(side, "at").groupBy("doc", "k").agg(F.max_by("v", "depth").alias("v"))
    return found.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list(F.concat("k", F.lit("="), "v", F.lit("\n")))), "").alias("extra"), F.collect_set("k").alias("named"))


def _text_pages(spark: SparkSession, root: str, docs: DataFrame) -> DataFrame:
    """docs(source, doc, body) of a folder to pages, with headers from sidecars before the default ones."""
    own = lambda key, value: F.when(F.array_contains(F.coalesce("named", F.array().cast("array<string>")), key), F.lit("")).otherwise(header({key: value}))
    rows = docs.join(_sidecars(spark, root, docs), "doc", "left")
    return _paged(rows.withColumn("head", F.concat(own("Name", F.col("doc")), own("Source", F.col("source")), F.coalesce("extra", F.lit("")))), cut_pages(F.col("body")))


def from_text_files(spark: SparkSession, source: str, path: str, pattern: str = "*.txt", limit: int | None = None) -> DataFrame:
    """A folder tree of text files; ``pattern`` may hold several globs set apart by ``;``.

    Headers come from ``<file>.dscr`` and the ``.dscr`` of every folder above; of equal keys the
    nearest wins, and a default header gives way to one of its key.
    """
    root = path.rstrip("/")
    files = _files(spark, root, pattern)
    files = files.limit(limit) if limit else files
    return _text_pages(spark, root, files.select(F.lit(source).alias("source"), _name(root).alias("doc"), decoded(F.col("content")).alias("body")))


def from_folder(spark: SparkSession, source: str, path: str, pattern: str = "*.txt;*.html;*.htm") -> DataFrame:
    """A folder tree of text and HTML files, each read by its ending; others are left out."""
    root = path.rstrip("/")
    files = _files(spark, root, pattern).select(_name(root).alias("doc"), "content")
    page = F.lower("doc").rlike(r"\.html?$")
    text = files.where(F.lower("doc").rlike(r"\.txt$")).select(F.lit(source).alias("source"), "doc", decoded(F.col("content")).alias("body"))
    return _text_pages(spark, root, text).unionByName(from_html(files.where(page).select("doc", decoded(F.col("content")).alias("html")), source, "doc", "html"))


def from_blobs(df: DataFrame, source: str, key: str, content: str, kind: str | None = None) -> DataFrame:
    """A document for each row of bytes: HTML or text as ``kind`` (a content type) or the bytes say.

    PDF has no reader here; such rows are left out, as are null ones.
    """
    rows = df.select(F.col(key).cast("string").alias("doc"), F.col(content).cast("binary").alias("b"), (F.lower(F.col(kind)) if kind else F.lit("")).alias("kind")).where("b IS NOT NULL")
    rows = rows.withColumn("text", decoded(F.col("b")))
    pdf = F.col("kind").contains("pdf") | (F.hex(F.substring("b", 1, 4)) == "25504446")
    html = F.col("kind").contains("html") | (~F.col("kind").contains("plain") & F.lower(F.substring("text", 1, 1000)).contains("<html"))
    rows = rows.withColumn("is_html", html).where(~pdf)
    return from_rows(rows.where("NOT is_html"), source, "doc", "text", []).unionByName(from_html(rows.where("is_html"), source, "doc", "text"))


def from_files(spark: SparkSession, df: DataFrame, source: str, key: str, file: str, base: str) -> DataFrame:
    """A document for each row that names a file below ``base``; rows whose file is missing drop."""
    root = base.rstrip("/")
    files = _files(spark, root, "*").select(_name(root).alias("f"), "content")
    named = df.select(F.col(key).cast("string").alias("doc"), F.regexp_replace(F.replace(F.col(file).cast("string"), F.lit("\\"), F.lit("/")), "^/+", "").alias("f"))
    return from_blobs(named.join(files, "f"), source, "doc", "content")


def from_jdbc(spark: SparkSession, source: str, url: str, query: str, key: str, text: str | None, headers: list[str], **options: str) -> DataFrame:
    """Rows of a database query as documents; ``options`` are those of the JDBC reader."""
    rows = spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
    return from_rows(rows, source, key, text, headers)


def from_xml(spark: SparkSession, source: str, path: str) -> DataFrame:
    """(source, file) of the documents that an XML manifest lists; records without file drop."""
    rows = spark.read.format("xml").option("rowTag", "document").load(path)
    bases = spark.read.format("xml").option("rowTag", "root").schema("basepath string").load(path)
    base = (bases.where("basepath IS NOT NULL").first() or [""])[0].strip()
    file = F.col("file").cast("string")
    return rows.where(file.isNotNull()).select(F.lit(source).alias("source"), F.when(file.contains("://"), file).otherwise(F.concat(F.lit(base), file)).alias("file"))


def from_manifest(spark: SparkSession, source: str, path: str, base: str) -> DataFrame:
    """The documents of an XML manifest whose files lie below ``base``, opened."""
    listed = from_xml(spark, source, path).where(~F.col("file").contains("://"))
    inner = F.regexp_replace(F.replace(F.col("file"), F.lit("\\"), F.lit("/")), "^" + re.escape(base.rstrip("/") + "/"), "")
    return from_files(spark, listed.select("file", inner.alias("f")), source, "f", "f", base)
