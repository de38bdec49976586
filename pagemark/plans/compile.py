"""A query tree to one DataFrame plan: words become bits of one mask, nodes boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stem_word
from ..operators.index import doc_keys, terms
from .query import Both, Either, Word, radius, words

WILDCARDS = 100


def looked_up(dictionary: DataFrame, leaves: list[Word], stems: bool, symmetric: bool = False, vocabulary: DataFrame | None = None) -> list[tuple[int, str]]:
    """(leaf, term): what to look up for each word; a few terms a word, at most WILDCARDS.

    Wildcards are looked up among the forms. A word that a vocabulary knows is looked up by its
    groups, one whose stem differs by its stem alone, so the stem's own form is not found unless
    ``symmetric``. Nothing runs for a request without wildcards and vocabulary.
    """
    out: list[tuple[int, str]] = []
    groups: dict[str, list[str]] = {}
    plain = {w.text: (stem_word(w.text) or w.text if stems else w.text) for w in leaves if "?" not in w.text}
    if vocabulary is not None and plain:
        known = terms(dictionary.sparkSession.createDataFrame([(w,) for w in plain], "word string"), [], stems, vocabulary)
        for r in known.where("kind = 'group'").collect():
            groups.setdefault(r["word"], []).append(r["term"])
    for i, w in enumerate(leaves):
        if "?" in w.text:
            found = dictionary.where((F.col("kind") == "form") & F.col("term").rlike(r"^\p{L}") & F.col("term").rlike(w.text.replace("?", ".*"))).orderBy("term").limit(WILDCARDS)
            out += [(i, r["term"]) for r in found.select("term").collect()]
        elif w.exact:
            out.append((i, w.text))
        elif w.text in groups:
            out += [(i, g) for g in groups[w.text]]
        else:
            s = plain[w.text]
            found = [w.text] if s == w.text else ["$" + s]
            out += [(i, t) for t in (dict.fromkeys([*found, s, "$" + s]) if symmetric else found)]
    return out


def leaf_terms(dictionary: DataFrame, leaves: list[Word], stems: bool, symmetric: bool = False) -> DataFrame:
    """``looked_up`` as a table (leaf, term)."""
    return dictionary.sparkSession.createDataFrame(looked_up(dictionary, leaves, stems, symmetric), "leaf int, term string")


def near(rows: DataFrame, a: Column, b: Column, r: int, name: str) -> DataFrame:
    """Add ``name``: members of islands of ``a`` and ``b`` that hold both.

    Members further than ``|r|`` from the one before begin an island (never, for 0). For a
    negative ``r``, what comes before an island's first member of ``a`` is left out. All windows
    are by document, so they share one exchange, and documents stay apart.
    """
    keys = doc_keys(rows)
    doc = Window.partitionBy(*keys).orderBy("coord")
    either = a | b
    before = F.max(F.when(either, F.col("coord"))).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    step = rows.withColumns({f"{name}_a": a, f"{name}_b": b, f"{name}_p": before})
    a, b, p = F.col(f"{name}_a"), F.col(f"{name}_b"), F.col(f"{name}_p")
    either = a | b
    cut = F.when(either & (F.col("coord") - p > abs(r)), 1).otherwise(0) if r else F.lit(0)
    step = step.withColumn(f"{name}_i", F.sum(cut).over(doc))
    island = Window.partitionBy(*keys, f"{name}_i")
    keep = either & (F.col("coord") >= F.min(F.when(a, F.col("coord"))).over(island)) if r < 0 else either
    step = step.withColumn(f"{name}_k", F.coalesce(keep, F.lit(False)))
    k = F.col(f"{name}_k")
    step = step.withColumn(name, k & F.max(a & k).over(island) & F.max(b & k).over(island))
    return step.drop(*[f"{name}_{x}" for x in "abpik"])


def evaluate(postings: DataFrame, found: list[tuple[int, str]], tree, dist: int = 255) -> DataFrame:
    """(source, doc, page_no, pos, coord, mask) of the hits of ``tree``; bit i of mask is word i.

    ``found`` has the terms of each word. They reach the scan as a filter, so that of a stored
    index, sorted by term, only the row groups that hold them are read. A word of a field counts
    one place behind a marker of its key, and the marker counts with it; markers have the bits
    behind those of the words.
    """
    leaves = words(tree)
    marks = list(dict.fromkeys(w.key for w in leaves if w.key))
    if len(leaves) + len(marks) > 63:
        raise ValueError("a query may have 63 words")
    bits: dict[str, int] = {}
    for i, term in [*found, *((len(leaves) + k, f"&{key}") for k, key in enumerate(marks))]:
        bits[term] = bits.get(term, 0) | 1 << i
    keys = doc_keys(postings)
    hits = postings.where(F.col("term").isin(*bits)) if bits else postings.where(F.lit(False))
    if marks and all(w.key for w in leaves):
        hits = hits.where("page_no = 0")
    mine = postings.sparkSession.createDataFrame(list(bits.items()), "term string, bits long")
    rows = hits.join(F.broadcast(mine), "term").groupBy(*keys, "coord").agg(F.bit_or("bits").alias("mask"), F.min("page_no").alias("page_no"), F.min("pos").alias("pos"))
    if marks:  # what stands beside each place; the same exchange as below
        by = Window.partitionBy(*keys).orderBy("coord")
        beside = lambda f, step: F.when(f("coord").over(by) == F.col("coord") + step, f("mask").over(by)).otherwise(F.lit(0).cast("long"))
        rows = rows.withColumns({"before": beside(F.lag, -1), "behind": beside(F.lead, 1)})
    seen = iter(range(len(leaves)))
    made = iter(range(10_000))
    has = lambda column, bit: F.col(column).bitwiseAND(F.lit(1 << bit)) != 0

    def visit(node, rows: DataFrame) -> tuple[Column, DataFrame]:
        if isinstance(node, Word):
            i = next(seen)
            if not node.key:
                return has("mask", i), rows
            m = len(leaves) + marks.index(node.key)
            return (has("mask", i) & has("before", m)) | (has("mask", m) & has("behind", i)), rows
        a, rows = visit(node.left, rows)
        b, rows = visit(node.right, rows)
        if isinstance(node, Either):
            return a | b, rows
        name = f"n{next(made)}"
        two = radius(node.left, dist), radius(node.right, dist)
        r = max(map(abs, two))
        return F.col(name), near(rows, a, b, -r if max(two) < 0 else r, name)

    kept, rows = visit(tree, rows)
    return rows.where(kept).select(*keys, "page_no", "pos", "coord", "mask")
