"""Packing of token sequences: exact complements by indexed length sums, then best fit.

An index from sums to the single lengths, pairs and triples that make them is built once from
the lengths that occur. What a length leaves of a sequence is looked up in it, and a combination
that is still in stock fills the sequence exactly. The residue goes by best fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, docs_of, materialise, pick, small_batches
from .tokens import encoder, vocabulary_path

SEQUENCE = 2048
END_ID = 0
#: Buckets that one length's pieces are ranked in, so that a common length is no single task.
RANK_BUCKETS = 64


def pieces_of(docs: DataFrame, vocabulary: str, limit: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    A document's ids and the end id make one piece; a longer one is cut so that only its first
    piece is below the limit. ``row`` tells rows with equal doc_ids apart. Null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            col, rows = batch.column(1), batch.column(2)
            doc_ids = np.array(batch.column(0).to_pylist(), dtype=object)
            row_ids = np.array(rows.to_pylist(), dtype=np.int64)
            for lo in range(0, len(col), 512):
                texts = [x or "" for x in col.slice(lo, 512).to_pylist()]
                for a, b in chunks(texts):
                    ids, n = encode(texts[a:b])
                    full = np.insert(ids, np.cumsum(n), end_id).astype("<u4", copy=False)
                    n = n + 1
                    count = -(-n // limit)
                    owner = np.repeat(np.arange(len(n)), count)
                    piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                    first = n - (count - 1) * limit
                    start = np.where(piece == 0, 0, first[owner] + (piece - 1) * limit)
                    length = np.where(piece == 0, first[owner], limit)
                    at = (np.cumsum(n) - n)[owner] + start
                    view = memoryview(full.tobytes())
                    crc = [zlib.crc32(view[4 * p : 4 * (p + m)]) for p, m in zip(at.tolist(), length.tolist())]
                    cols = [pa.array(row_ids[lo + a : lo + b][owner]), pa.array(doc_ids[lo + a : lo + b][owner].tolist(), pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([full[p : p + m].tolist() for p, m in zip(at.tolist(), length.tolist())], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


class _Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.plan: list[tuple[tuple[int, ...], int]] = []

    def take(self, lengths: tuple[int, ...], most: int | None = None) -> int:
        """Fill as many sequences with these lengths as there are pieces for."""
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(self.left[x]) // k for x, k in need.items())
        times = times if most is None else min(times, most)
        if times > 0:
            for x, k in need.items():
                self.left[x] -= k * times
            self.plan.append((lengths, times))
        return times


class SumIndex:
    """Combinations of one, two and three available lengths by their sum.

    ``pairs[s]`` has the smaller length of every pair with the sum s, ``triples[s]`` the smallest
    length of triples (whose others are a pair without a smaller one). The largest come first: a
    short piece fits nearly anywhere, so combinations of even lengths are spent before it. Stock
    only falls, so an entry that has run out is passed for good.
    """

    def __init__(self, counts: np.ndarray, limit: int):
        there = counts[: limit + 1] > 0
        self.pairs, self.triples = [], []
        for s in range(limit + 1):
            low = np.arange(1, s // 2 + 1)
            good = there[low] & there[s - low]
            if s and s % 2 == 0:
                good[-1] &= counts[s // 2] > 1
            self.pairs.append((np.flatnonzero(good)[::-1] + 1).tolist())
        best = np.array([p[0] if p else 0 for p in self.pairs])
        for s in range(limit + 1):
            low = np.arange(1, s // 3 + 1)
            self.triples.append((np.flatnonzero(there[low] & (best[s - low] >= low))[::-1] + 1).tolist())

    def pair(self, left: np.ndarray, s: int, held: tuple[int, ...], least: int = 1) -> tuple[int, int] | None:
        """Two lengths in stock besides ``held`` with that sum, as even as can be, none below ``least``."""
        lows = self.pairs[s]
        while lows and not (left[lows[0]] and left[s - lows[0]]):
            lows.pop(0)
        for low in lows:
            if low < least:
                break
            high = s - low
            if left[low] > held.count(low) + (low == high) and left[high] > held.count(high):
                return high, low
        return None

    def find(self, left: np.ndarray, base: int, s: int, parts: int) -> tuple[int, ...] | None:
        """That many lengths in stock, besides one of ``base``, with the sum ``s``."""
        if parts == 1:
            return (s,) if left[s] > (s == base) else None
        if parts == 2:
            return self.pair(left, s, (base,))
        lows = self.triples[s]
        while lows and not left[lows[0]]:
            lows.pop(0)
        for low in lows:
            if left[low] > (low == base) and (two := self.pair(left, s - low, (base, low), low)):
                return (*two, low)
        return None


def plan_sequences(counts: np.ndarray, limit: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, for ``counts[length]`` pieces.

    From the longest length down, the gap that a length leaves is looked up among single
    lengths; then, for what is left, among sums of two, and then of three, each under what is
    still there. Such patterns fill a sequence exactly. No two pieces over half a sequence (wide
    ones) can share one, so short pieces are put together without a wide one, or several with
    one, only as far as the rest can spare them. What finds no exact partner goes by best fit,
    longest first.
    The input is a histogram of ``limit`` numbers, whatever the number of documents.
    """
    stock = _Stock(counts)
    stock.take((limit,))
    index = SumIndex(stock.left, limit)
    for parts in (1, 2, 3):
        _exact(stock, index, limit, parts)
    return stock.plan + _best_fit(stock.left, limit)


def _exact(stock: _Stock, index: SumIndex, limit: int, parts: int) -> None:
    """Use up exact fillings of a length's gap with ``parts`` pieces."""
    left = stock.left
    for long in range(limit - 1, 0, -1):
        while left[long] and (found := index.find(left, long, limit - long, parts)):
            size = np.arange(len(left))
            wide, slim = int(left[2 * size > limit].sum()), int(left[2 * size <= limit].sum())
            # Pieces that the wide ones can spare, and sequences that may do without a wide one.
            spare, free = slim - 2 * wide, -(-int((left * size).sum()) // limit) - wide
            alone = 2 * long <= limit
            room = min([spare] * (parts > 1) + [free] * alone, default=None)
            if room is not None and room <= 0 or not stock.take((long, *found), room):
                break


def _best_fit(counts: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for whole runs of equal lengths; open sequences by their gap."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for long in range(limit, 0, -1):
        n = int(counts[long])
        while n:
            gap = next((g for g in range(long, limit) if gaps.get(g)), None)
            if gap is None:
                fit = limit // long
                whole, rest = divmod(n, fit)
                if whole:
                    gaps.setdefault(limit - fit * long, []).append(((long,) * fit, whole))
                if rest:
                    gaps.setdefault(limit - rest * long, []).append(((long,) * rest, 1))
                break
            held, times = gaps[gap].pop()
            used = min(n, times)
            if times > used:
                gaps[gap].append((held, times - used))
            gaps.setdefault(gap - long, []).append(((*held, long), used))
            n -= used
    return [run for runs in gaps.values() for run in runs]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, last, sequence, offset): the places of one length, by its rank.

    Rank r with first <= r <= last goes to sequence + r - first at that offset.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            first = taken.get(x, 0)
            rows.append((x, first, first + times - 1, sequence, offset))
            taken[x] = first + times
            offset += x
        sequence += times
    return rows


def pack(pieces: DataFrame, limit: int = SEQUENCE) -> DataFrame:
    """``pieces`` with sequence_id and offset; every piece goes into exactly one sequence.

    Only the histogram of lengths reaches the driver. The plan has a bounded number of runs for
    each length, so it is sent to every executor; pieces are ranked within their length in
    ``RANK_BUCKETS`` buckets and looked up in it. Ties are broken by the piece's row.
    """
    spark = pieces.sparkSession
    cols = pieces.columns
    salted = pieces.withColumn("__b", F.pmod(F.xxhash64("row", "piece"), F.lit(RANK_BUCKETS)).cast("int"))
    per = salted.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n"))
    rows = per.collect()  # at most limit x RANK_BUCKETS numbers
    counts = np.zeros(limit + 1, dtype=np.int64)
    for r in rows:
        counts[r["length"]] += r["n"]
    plan = _slots(plan_sequences(counts, limit))
    before, base = {}, []
    for r in sorted(rows, key=lambda r: (r["length"], r["__b"])):
        base.append((int(r["length"]), int(r["__b"]), before.get(r["length"], 0)))
        before[r["length"]] = before.get(r["length"], 0) + r["n"]
    order = np.lexsort(([p[1] for p in plan], [p[0] for p in plan])) if plan else []
    table = np.array([plan[i] for i in order], dtype=np.int64).reshape(-1, 5)
    offsets = np.array(base, dtype=np.int64).reshape(-1, 3)
    ranked = salted.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__b").orderBy("row", "piece")) - 1)
    shared = spark.sparkContext.broadcast((table, offsets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offsets = shared.value
        span = np.int64(1) << np.int64(44)
        slot_keys = table[:, 0] * span + table[:, 1]
        base_keys = offsets[:, 0] * RANK_BUCKETS + offsets[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, bucket, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "__b", "__r"))
            rank = rank + offsets[np.searchsorted(base_keys, length * RANK_BUCKETS + bucket), 2]
            slot = table[np.searchsorted(slot_keys, length * span + rank, "right") - 1]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in cols]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], names=[*cols, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema)


def best_fit_pack(docs: DataFrame, vocabulary: str | None = None, limit: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` and their places in sequences of ``limit`` tokens.

    Null texts are empty and take one end id. Rows with a null doc_id and repeated rows are
    packed like any other, a piece for each row. An empty table gives no sequence. Other columns
    are ignored. ``with_ids`` adds each piece's ids.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    pieces = materialise(pieces_of(docs, vocabulary, limit, with_ids=with_ids), "pieces")
    return pack(pieces, limit).drop("row")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(docs_of(spark, sf_dir))
