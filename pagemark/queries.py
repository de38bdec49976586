"""The registered queries of the search engine, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import text as tx
from .operators import index, rank, words
from .plans.query import Either, Word, parse, radius
from .plans.query import words as leaves_of
from .shared import spread
from .sources import pages as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STOPS = ["and", "that", "with"]


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("lang", "Lang")
    return sources.from_rows(docs, "documents", "doc_id", "text", ["Lang", "source"])


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine.build(document_pages(spark, sf_dir), stems=False)


# -- SQL fragments ----------------------------------------------------------------------------

_PAGES = """d AS (SELECT CAST(doc_id AS VARCHAR) AS doc, coalesce(text, '') AS body,
  'Name=' || doc_id || chr(10) || 'Source=documents' || chr(10) || coalesce('Lang=' || regexp_replace(lang, '[\\n\\r=]', ' ', 'g') || chr(10), '') || coalesce('source=' || regexp_replace(source, '[\\n\\r=]', ' ', 'g') || chr(10), '') AS head FROM documents),
pages AS (SELECT doc, 0 AS page_no, head AS text FROM d UNION ALL
  SELECT doc, CAST(i AS INTEGER) + 1 AS page_no, substring(body, CAST(i AS BIGINT) * 3000 + 1, 3000) AS text FROM (SELECT doc, body, unnest(range(greatest(CAST(ceil(length(body) / 3000.0) AS BIGINT), 1))) AS i FROM d)),
page_map AS (SELECT doc, page_no, CAST(sum(length(text)) OVER (PARTITION BY doc ORDER BY page_no) - length(text) AS BIGINT) AS start, CAST(sum(length(text)) OVER (PARTITION BY doc ORDER BY page_no) AS BIGINT) AS "end" FROM pages)"""


def _scan(name: str, source: str, keys: str, text: str, pattern: str) -> str:
    """A CTE of all matches of a pattern: keys, word, pos."""
    return f"""{name}_r AS (SELECT {keys}, row_number() OVER () AS rid, regexp_extract_all({text}, '{pattern}') AS w, string_split_regex({text}, '{pattern}') AS g FROM {source}),
{name}_u AS (SELECT {keys}, rid, unnest(w) AS word, unnest(list_slice(g, 1, len(w))) AS gap, generate_subscripts(w, 1) AS i FROM {name}_r),
{name} AS (SELECT {keys}, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY rid ORDER BY i) - length(word) AS INTEGER) AS pos FROM {name}_u)"""


_BODY = _scan("every", "(SELECT doc, page_no, lower(text) AS low FROM pages WHERE page_no > 0)", "doc, page_no", "low", r"\p{L}+|\p{N}+") + ",\ntokens AS (SELECT * FROM every WHERE length(word) BETWEEN 3 AND 32)"
_HEADS = (
    _scan("lines", "(SELECT doc, lower(text) AS low FROM pages WHERE page_no = 0)", "doc", "low", r"[^\n]+")
    + ",\nkv AS (SELECT doc, string_split(word, '=')[1] AS key, string_split(word, '=')[2] AS value, pos + length(string_split(word, '=')[1]) + 1 AS off FROM lines WHERE contains(word, '=') AND length(string_split(word, '=')[1]) >= 3),\n"
    + _scan("hw", "kv", "doc, key, off", "value", r"[\p{L}\p{N}_]+")
    + ",\nheads AS (SELECT doc, key, CAST(off + pos AS INTEGER) AS pos, word FROM hw)"
)
_POSTINGS = """marks AS (SELECT DISTINCT '&' || key AS term, 'field' AS kind, doc, 0 AS page_no, pos - 1 AS pos FROM heads),
postings AS (SELECT term, kind, p.doc, p.page_no, pos, start + pos AS coord FROM (
  SELECT word AS term, 'form' AS kind, doc, page_no, pos FROM tokens UNION ALL SELECT word, 'form', doc, 0, pos FROM heads UNION ALL SELECT * FROM marks) p JOIN page_map m ON p.doc = m.doc AND p.page_no = m.page_no),
dictionary AS (SELECT term, kind, count(*) AS n_postings, count(DISTINCT doc) AS n_docs FROM postings GROUP BY term, kind)"""
_INDEX = f"WITH {_PAGES},\n{_BODY},\n{_HEADS},\n{_POSTINGS}"


def search_sql(request: str, dist: int = 255, source: str = "postings", prefix: str = "q") -> str:
    """CTEs up to ``{prefix}_hits(doc, page_no, pos, coord, mask)`` for a request without stems."""
    parsed = parse(request)
    tree = parsed.body if parsed.body is not None else parsed.fields[0][1]
    leaves = leaves_of(tree)
    looked = []
    for i, w in enumerate(leaves):
        if "?" in w.text:
            pattern = w.text.replace("?", ".*")
            looked.append(f"(SELECT {i} AS leaf, term FROM dictionary WHERE kind = 'form' AND regexp_matches(term, '^\\p{{L}}') AND regexp_matches(term, '{pattern}') ORDER BY term LIMIT 100)")
        else:
            looked.append(f"(SELECT {i} AS leaf, '{w.text}' AS term)")
    p = prefix
    ctes = [
        f"{p}_l AS ({' UNION ALL '.join(looked)})",
        f"{p}_0 AS (SELECT doc, coord, bit_or(CAST(1 AS BIGINT) << leaf) AS mask, min(page_no) AS page_no, min(pos) AS pos FROM {source} JOIN {p}_l USING (term) GROUP BY doc, coord)",
    ]
    seen, made = iter(range(len(leaves))), iter(range(100))
    state = {"at": f"{p}_0", "cols": "doc, page_no, pos, coord, mask"}

    def visit(node) -> str:
        if isinstance(node, Word):
            return f"((mask & {1 << next(seen)}) <> 0)"
        a, b = visit(node.left), visit(node.right)
        if isinstance(node, Either):
            return f"({a} OR {b})"
        k = f"n{next(made)}"
        two = radius(node.left, dist), radius(node.right, dist)
        r, ordered = max(map(abs, two)), max(two) < 0
        cut = f"CASE WHEN ({k}a OR {k}b) AND coord - p > {r} THEN 1 ELSE 0 END" if r else "0"
        keep = f"({k}a OR {k}b)" + (f" AND coalesce(coord >= min(CASE WHEN {k}a THEN coord END) OVER (PARTITION BY doc, isl), false)" if ordered else "")
        cols = state["cols"]
        ctes.extend([
            f"{p}_{k}1 AS (SELECT {cols}, {a} AS {k}a, {b} AS {k}b FROM {state['at']})",
            f"{p}_{k}2 AS (SELECT *, max(CASE WHEN {k}a OR {k}b THEN coord END) OVER (PARTITION BY doc ORDER BY coord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {p}_{k}1)",
            f"{p}_{k}3 AS (SELECT *, sum({cut}) OVER (PARTITION BY doc ORDER BY coord) AS isl FROM {p}_{k}2)",
            f"{p}_{k}4 AS (SELECT *, {keep} AS kept FROM {p}_{k}3)",
            f"{p}_{k} AS (SELECT {cols}, kept AND bool_or({k}a AND kept) OVER (PARTITION BY doc, isl) AND bool_or({k}b AND kept) OVER (PARTITION BY doc, isl) AS {k} FROM {p}_{k}4)",
        ])
        state["at"], state["cols"] = f"{p}_{k}", f"{cols}, {k}"
        return k

    last = visit(tree)
    ctes.append(f"{p}_hits AS (SELECT doc, page_no, pos, coord, mask FROM {state['at']} WHERE {last})")
    return ",\n".join(ctes)


_RANKS = """gaps AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc, page_no ORDER BY pos) AS gap FROM q_hits),
page_ranks AS (SELECT doc, page_no, count(*) AS n, 1 + coalesce(sum(CASE WHEN gap IS NULL THEN 0 ELSE 30 // greatest(5, gap) END), 0) + ln(count(*)) AS rank FROM gaps GROUP BY doc, page_no),
doc_ranks AS (SELECT doc, count(*) FILTER (page_no > 0) AS n_pages, (1 + ln(sum(rank))) * CASE WHEN min(page_no) = 0 THEN 10 ELSE 1 END AS rank FROM page_ranks GROUP BY doc)"""


# -- sources and tokens -----------------------------------------------------------------------


@_query(f"WITH {_PAGES} SELECT doc, page_no, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest FROM pages")
def text_pages(spark, d):
    return document_pages(spark, d).select("doc", "page_no", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@_query(f"WITH {_PAGES},\n{_BODY} SELECT doc, page_no, pos, word FROM every")
def tokenize_positions(spark, d):
    return index.tokens(document_pages(spark, d), lengths=False).select("doc", "page_no", "pos", "word")


@_query(f"WITH {_PAGES},\n{_BODY} SELECT doc, count(*) AS kept, CAST(sum(pos) AS BIGINT) AS positions FROM tokens GROUP BY doc")
def token_length_filter(spark, d):
    return index.tokens(document_pages(spark, d)).groupBy("doc").agg(F.count(F.lit(1)).alias("kept"), F.sum("pos").cast("long").alias("positions"))


@_query(f"{_INDEX} SELECT term, n_postings FROM dictionary WHERE kind = 'form' AND term NOT IN ('and', 'that', 'with')")
def stop_word_filter(spark, d):
    post = index.postings(document_pages(spark, d), STOPS, stems=False)
    return index.dictionary(post).where("kind = 'form'").select("term", "n_postings")


@_query(f"{_INDEX} SELECT term, kind, n_postings, n_docs FROM dictionary")
def doc_frequency(spark, d):
    return engine(spark, d).dictionary.select("term", "kind", "n_postings", "n_docs")


@_query(f"{_INDEX} SELECT term, count(*) AS n, min(coord) AS low, max(coord) AS high, CAST(sum(coord) AS BIGINT) AS total FROM postings GROUP BY term")
def posting_lists(spark, d):
    return engine(spark, d).postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("coord").alias("low"), F.max("coord").alias("high"), F.sum("coord").alias("total"))


@_query(f"""{_INDEX}, g AS (SELECT term, coord - coalesce(lag(coord) OVER (PARTITION BY term, doc ORDER BY coord), 0) AS delta FROM postings)
SELECT term, CAST(sum(greatest(1, CAST(ceil(length(bin(delta)) / 15.0) AS INTEGER))) AS BIGINT) AS units FROM g GROUP BY term""")  # fmt: skip
def posting_units(spark, d):
    from pyspark.sql import Window

    gap = F.col("coord") - F.coalesce(F.lag("coord").over(Window.partitionBy("term", "doc").orderBy("coord")), F.lit(0))
    return engine(spark, d).postings.select("term", tx.posting_units(gap).alias("u")).groupBy("term").agg(F.sum("u").cast("long").alias("units"))


@_query(f'WITH {_PAGES} SELECT doc, page_no, start, "end" FROM page_map')
def page_map(spark, d):
    return index.page_map(document_pages(spark, d)).select("doc", "page_no", "start", "end")


@_query(f'{_INDEX} SELECT p.doc, p.coord, m.page_no FROM postings p JOIN page_map m ON p.doc = m.doc AND p.coord >= m.start AND p.coord < m."end" WHERE p.term = \'with\'')
def coord_to_page(spark, d):
    e = engine(spark, d)
    hits = e.postings.where("term = 'with'").select("doc", "coord")
    where = index.page_map(e.pages)
    return hits.join(where, "doc").where("coord >= start AND coord < end").select("doc", "coord", "page_no")


# -- words ------------------------------------------------------------------------------------


@_query(f"{_INDEX} SELECT doc, page_no, pos, coord FROM postings WHERE term = 'that' AND kind = 'form'")
def term_lookup_exact(spark, d):
    return engine(spark, d).postings.where("term = 'that' AND kind = 'form'").select("doc", "page_no", "pos", "coord")


@_query(f"{_INDEX} SELECT term FROM dictionary WHERE kind = 'form' AND regexp_matches(term, '^\\p{{L}}') AND regexp_matches(term, '.*tion.*an.*') ORDER BY term LIMIT 100")
def wildcard_terms(spark, d):
    from .plans.compile import leaf_terms

    return leaf_terms(engine(spark, d).dictionary, [Word("?tion?an?", True)], False).select("term")


@_query(f"{_INDEX} SELECT substring(term, 4) AS suffix, n_postings FROM dictionary WHERE kind = 'form' AND starts_with(term, 'the') AND length(term) > 3 ORDER BY n_postings DESC, term LIMIT 10")
def prefix_suggest(spark, d):
    return engine(spark, d).suggest("and the")


@_query(f"{_INDEX} SELECT term, CAST(levenshtein(term, 'thing') AS INTEGER) AS distance FROM dictionary WHERE kind = 'form' ORDER BY distance, term LIMIT 10")
def close_words(spark, d):
    return engine(spark, d).close_words("thing")


@_query(f"{_INDEX} SELECT term, n_postings, n_postings * 1000.0 / (SELECT CAST(sum(length(text)) AS DOUBLE) FROM pages) AS per_mille FROM dictionary WHERE kind = 'form' ORDER BY n_postings DESC, term LIMIT 1000".replace("n_postings * 1000.0 / (SELECT CAST(sum(length(text)) AS DOUBLE) FROM pages)", "round(CAST(n_postings AS DOUBLE) * 1000.0 / (SELECT CAST(sum(length(text)) AS DOUBLE) FROM pages), 6)"))
def histogram(spark, d):
    e = engine(spark, d)
    total = e.pages.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 1
    return words.histogram(e.dictionary, float(total)).withColumn("per_mille", F.round("per_mille", 6))


# -- searches ---------------------------------------------------------------------------------

_HITS = "SELECT doc, page_no, pos, coord FROM q_hits"


def _search(name: str, request: str, dist: int = 255) -> None:
    def run(spark, d):
        return engine(spark, d).search(request, dist).hits.select("doc", "page_no", "pos", "coord")

    QUERIES[name] = run
    SQL[name] = f"{_INDEX},\n{search_sql(request, dist)}\n{_HITS}"


_search("proximity_and", "the and", 40)
_search("proximity_ordered", '"the and"')
_search("posting_or", "that | with")
_search("nested_and_or", "the (that | with) and", 40)
_search("phrase_three_terms", '"the and that"')
_search("wildcard_search", "?tiontion? the", 40)


@_query(f"{_INDEX},\nfh AS (SELECT p.* FROM postings p WHERE p.page_no = 0 AND EXISTS (SELECT 1 FROM postings m WHERE m.term = '&lang' AND m.doc = p.doc AND m.coord + 1 = p.coord)),\n{search_sql('{lang=de|fr}', source='fh')}\nSELECT DISTINCT doc FROM q_hits")
def field_search(spark, d):
    return engine(spark, d).field_hits("lang", parse("{lang=de|fr}").fields[0][1]).select("doc").distinct()


@_query(f"{_INDEX},\nfh AS (SELECT p.* FROM postings p WHERE p.page_no = 0 AND EXISTS (SELECT 1 FROM postings m WHERE m.term = '&lang' AND m.doc = p.doc AND m.coord + 1 = p.coord)),\n{search_sql('{lang=en}', source='fh', prefix='f')},\n{search_sql('that with', 40)}\nSELECT doc, count(*) AS n FROM q_hits WHERE doc IN (SELECT doc FROM f_hits) GROUP BY doc")
def field_and_body(spark, d):
    found = engine(spark, d).search("that with {lang=en}", 40)
    return found.pages.groupBy("doc").agg(F.sum("n").alias("n"))


@_query(f"{_INDEX},\n{search_sql('that with', 40)},\n{_RANKS} SELECT doc, n_pages, round(rank, 6) AS rank FROM doc_ranks WHERE regexp_matches('documents:' || doc, '^documents:1') OR regexp_matches('documents:' || doc, '7$') ORDER BY doc_ranks.rank DESC, doc LIMIT 500")
def doc_name_filter(spark, d):
    return engine(spark, d).search("that with -filter:^documents:1,7$", 40).docs.select("doc", "n_pages", F.round("rank", 6).alias("rank"))


@_query(f"{_INDEX},\n{search_sql('that with', 40)},\n{_RANKS} SELECT doc, page_no, n, round(rank, 6) AS rank FROM page_ranks")
def page_rank(spark, d):
    return engine(spark, d).search("that with", 40).pages.select("doc", "page_no", "n", F.round("rank", 6).alias("rank"))


@_query(f"{_INDEX},\n{search_sql('that | with | lang')},\n{_RANKS} SELECT doc, n_pages, round(rank, 6) AS rank FROM doc_ranks")
def doc_rank(spark, d):
    return rank.doc_ranks(engine(spark, d).search("that | with | lang").pages).select("doc", "n_pages", F.round("rank", 6).alias("rank"))


@_query(f"{_INDEX},\n{search_sql('that with', 40)},\n{_RANKS} SELECT doc, n_pages, round(rank, 6) AS rank FROM doc_ranks ORDER BY doc_ranks.rank DESC, doc LIMIT 500")
def top_docs(spark, d):
    return engine(spark, d).search("that with", 40).docs.select("doc", "n_pages", F.round("rank", 6).alias("rank"))


@_query(f"{_INDEX},\n{search_sql('the')},\n{_RANKS} SELECT doc, page_no, n FROM page_ranks ORDER BY doc, page_no LIMIT 100")
def page_cap(spark, d):
    return rank.cap_pages(engine(spark, d).search("the").pages, 100).select("doc", "page_no", "n")


@_query(f"{_INDEX},\n{search_sql('the (that | with)', 40)} SELECT CASE leaf WHEN 0 THEN 'the' WHEN 1 THEN 'that' ELSE 'with' END AS word, count(*) AS n FROM q_hits, (SELECT unnest([0, 1, 2]) AS leaf) WHERE (mask & (1 << leaf)) <> 0 GROUP BY leaf")
def word_info(spark, d):
    found = engine(spark, d).search("the (that | with)", 40)
    return rank.word_info(found.hits, list(found.words))


@_query()
def snippet_window(spark, d):
    e = engine(spark, d)
    shown = rank.snippets(e.search("that with", 40).pages, e.pages)
    return shown.select("doc", "page_no", "text", F.array_join("words", ",").alias("words"))


@_query()
def summary_top_pages(spark, d):
    e = engine(spark, d)
    s = rank.summaries(rank.snippets(e.search("that with", 40).pages, e.pages))
    return s.select("doc", "summary", F.array_join("found_words", ",").alias("found_words"))


@_query()
def stem_search(spark, d):
    e = Engine.build(document_pages(spark, d), stems=True)
    return e.search("inging | ertion | things", 255).hits.select("doc", "page_no", "pos", "coord")


@_query()
def search_json(spark, d):
    e = engine(spark, d)
    return e.json(e.search("that with", 40))


_TWO = _INDEX.replace("FROM documents)", """FROM documents UNION ALL
  SELECT 'benchmark:' || item_id, coalesce(text, ''), 'Name=' || item_id || chr(10) || 'Source=benchmark' || chr(10) FROM benchmark)""").replace("CAST(doc_id AS VARCHAR) AS doc", "'documents:' || doc_id AS doc")


@_query(f"{_TWO},\n{search_sql('that with', 40)}\nSELECT doc, count(*) AS n, CAST(sum(coord) AS BIGINT) AS coords FROM q_hits GROUP BY doc")
def two_sources(spark, d):
    """Documents of two sources have the same names here, and stay apart."""
    other = sources.from_rows(table(spark, d, "benchmark"), "benchmark", "item_id", "text", [])
    hits = Engine.build(document_pages(spark, d).union(other), stems=False).search("that with", 40).hits
    return hits.groupBy(F.concat_ws(":", "source", "doc").alias("doc")).agg(F.count(F.lit(1)).alias("n"), F.sum("coord").alias("coords"))


def _near_fields(a: tuple[str, str], b: tuple[str, str], r: int) -> str:
    one = lambda key, word, flag: f"SELECT m.doc, unnest([m.coord, p.coord]) AS coord, {flag} FROM postings m JOIN postings p ON m.doc = p.doc AND p.coord = m.coord + 1 WHERE m.term = '&{key}' AND p.term = '{word}'"
    return f"""u AS (SELECT doc, coord, bool_or(a) AS a, bool_or(b) AS b FROM ({one(*a, 'true AS a, false AS b')} UNION ALL {one(*b, 'false, true')}) GROUP BY doc, coord),
g AS (SELECT *, coord - lag(coord) OVER (PARTITION BY doc ORDER BY coord) AS gap FROM u),
i AS (SELECT *, sum(CASE WHEN gap > {r} THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY coord) AS isl FROM g)
SELECT DISTINCT doc FROM (SELECT doc FROM i GROUP BY doc, isl HAVING bool_or(a) AND bool_or(b))"""


@_query(f"{_INDEX},\n{_near_fields(('lang', 'en'), ('source', 'src3'), 9)}")
def two_fields(spark, d):
    """Every document with both fields near each other in the header page; ``docs`` would show the best 500 only."""
    return engine(spark, d).search("{lang=en} {source=src3}", 5).pages.select("doc").distinct()


@_query(f"""{_INDEX},\n{search_sql('that with', 40)},\n{_RANKS},
best AS (SELECT * FROM doc_ranks ORDER BY rank DESC, doc LIMIT 500),
shown AS (SELECT doc, page_no, string_agg(pos, ' ' ORDER BY pos) AS places FROM q_hits WHERE page_no > 0 GROUP BY doc, page_no)
SELECT b.doc AS doc, round(b.rank, 6) AS rank, 'Lang=' || lang || ';Name=' || b.doc || ';Source=documents;source=' || source AS headers, s.pages AS pages
FROM best b JOIN documents d ON b.doc = CAST(d.doc_id AS VARCHAR) LEFT JOIN (SELECT doc, string_agg(page_no || ':' || places, ';' ORDER BY page_no) AS pages FROM shown GROUP BY doc) s ON s.doc = b.doc""")  # fmt: skip
def search_documents(spark, d):
    """Headers and positions of a search's documents, which its answer holds."""
    e = engine(spark, d)
    full = e.documents(e.search("that with", 40))
    heads = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    places = F.array_join(F.transform("pages", lambda p: F.concat(p["page_no"].cast("string"), F.lit(":"), F.array_join(F.transform(p["positions"], lambda x: x.cast("string")), " "))), ";")
    return full.select("doc", F.round("rank", 6).alias("rank"), heads.alias("headers"), places.alias("pages"))


# -- headers, rows, markup --------------------------------------------------------------------


@_query(f"WITH {_PAGES},\n{_HEADS} SELECT doc, key, value FROM kv")
def header_map(spark, d):
    return index.fields(document_pages(spark, d)).select("doc", "key", "value")


@_query("SELECT 'Name=' || p_partkey || chr(10) || 'Source=parts' || chr(10) || 'p_brand=' || p_brand || chr(10) || 'p_size=' || p_size || chr(10) AS text, CAST(p_partkey AS VARCHAR) AS doc FROM part")
def row_source_headers(spark, d):
    return sources.from_rows(table(spark, d, "part"), "parts", "p_partkey", None, ["p_brand", "p_size"]).select("doc", "text")


@_query("""SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn + 1 AS INTEGER) AS page_no, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 0, 'Name=' || conv_id || chr(10) || 'Source=chats' || chr(10) FROM conversations""")
def conversation_pages(spark, d):
    return sources.from_pages(table(spark, d, "conversations"), "chats", "conv_id", "turn", "text").select("doc", "page_no", "text")


@_query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN try_cast(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.') THEN 'long' WHEN try_cast(v AS DECIMAL(38, 10)) IS NOT NULL THEN 'decimal' ELSE 'string' END AS kind
FROM (SELECT unnest([CAST(p_partkey AS VARCHAR), p_brand, CAST(p_size AS VARCHAR), p_name]) AS v FROM part)) GROUP BY kind""")
def dynamic_header_types(spark, d):
    values = table(spark, d, "part").select(F.explode(F.array(F.col("p_partkey").cast("string"), "p_brand", F.col("p_size").cast("string"), "p_name")).alias("v"))
    return values.select(tx.typed_value(F.col("v")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_HTML = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
'<(script|style)\b.*?</(script|style)\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<img\b[^>]*?\balt="([^"]*)"[^>]*>', ' \1 ', 'gis'), '<[^>]*>', ' ', 'gs'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(10) || chr(13) || chr(9))"""


@_query(f"SELECT page_id, {_HTML} AS text FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


@_query(r"""SELECT DISTINCT page_id, link FROM (SELECT page_id, lower(regexp_replace(unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1)), '#.*$', '')) AS link FROM pages)
WHERE link <> '' AND length(link) <= 1024 AND NOT regexp_matches(link, '\.(png|jpe?g|gif|bmp|svg|ico)$')""")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(tx.html_links(F.col("html"))).alias("link"))


@_query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\n=]', ' ', 'g')) AS title FROM pages")
def html_headers(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"))


# -- vocabularies -----------------------------------------------------------------------------

_VOCAB = "('and', 1), ('end', 3), ('that', 2), ('the', 6), ('them', 5), ('with', 4)"


@_query(f"{_INDEX}, v AS (SELECT * FROM (VALUES {_VOCAB}) t(stem, grp)) SELECT '#' || grp AS term, count(*) AS n FROM postings JOIN v ON term = stem WHERE kind = 'form' GROUP BY grp")
def vocab_lookup(spark, d):
    vocab = spark.sql(f"SELECT * FROM VALUES {_VOCAB} t(stem, grp)")
    post = index.postings(document_pages(spark, d), stems=False, vocabulary=vocab)
    return post.where("kind = 'group'").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH RECURSIVE l AS (SELECT p_brand AS a, p_type AS b FROM part), w AS (SELECT a AS g, a AS s FROM l UNION SELECT a, b FROM l),
r AS (SELECT DISTINCT s, s AS label FROM w UNION SELECT y.s, r.label FROM r JOIN w x ON x.s = r.s JOIN w y ON y.g = x.g) SELECT s AS stem, min(label) AS root FROM r GROUP BY s""")
def vocab_components(spark, d):
    lemmas = table(spark, d, "part").select(F.col("p_type").alias("word"), F.col("p_brand").alias("lemma"))
    return words.vocabulary(lemmas, stems=False)
