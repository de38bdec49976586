"""Token files with directly addressable codes: any token is read without decoding a block.

A file image holds the ids of a run of documents. An id is cut into 8-bit chunks, lowest first.
Level 0 has the first chunk of every id; a bitmap says which ids go on, and level k + 1 has the
next chunk of just those. A rank directory with a running count for every 512 bits finds an
id's chunk on the next level in constant time.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, docs_of, pick, scratch_root
from .tokens import encoder, vocabulary_path

MAGIC = b"DAC1"
END_ID = 2
#: Ids in one file image; one image is held in memory at a time.
SHARD_IDS = 1 << 21
_RANK_BITS = 512


def pack_codes(ids: np.ndarray) -> bytes:
    """The image of ``ids`` (unsigned, 32 bits)."""
    levels, rest = [], np.ascontiguousarray(ids, dtype=np.uint32)
    while len(rest) or not levels:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), _RANK_BITS)) if len(more) else np.empty(0, np.int64)
        ranks = np.concatenate(([0], np.cumsum(counts)[:-1])).astype("<u8") if len(more) else np.empty(0, "<u8")
        levels.append(((rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes(), len(rest)))
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", n) for *_, n in levels)
    return head + b"".join(part for chunk, bits, ranks, _ in levels for part in (ranks, chunk, bits))


class Codes:
    """Random access to the ids of an image."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token file")
        (n_levels,) = struct.unpack_from("<I", image, 4)
        sizes = struct.unpack_from(f"<{n_levels}Q", image, 8)
        at = 8 + 8 * n_levels
        self.levels = []
        for n in sizes:
            blocks = -(-n // _RANK_BITS)
            ranks = np.frombuffer(image, "<u8", blocks, at)
            chunk = np.frombuffer(image, np.uint8, n, at := at + 8 * blocks)
            bits = np.frombuffer(image, np.uint8, -(-n // 8), at := at + n)
            at += len(bits)
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``, from one chunk and one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """The number of set bits before place ``i``."""
        block = i // _RANK_BITS
        part = bits[block * (_RANK_BITS // 8) : (i >> 3) + 1].copy()
        part[-1] &= (1 << (i & 7)) - 1
        return int(ranks[block]) + int(np.bitwise_count(part).sum())

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids at ``start`` .. ``stop`` - 1; nothing outside that range is touched."""
        out = np.zeros(stop - start, dtype=np.uint32)
        where = None
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            if start >= stop:
                break
            part = chunk[start:stop].astype(np.uint32) << np.uint32(8 * k)
            if where is None:
                out |= part
            else:
                out[where] |= part
            some = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            inner = np.flatnonzero(some)
            where = inner if where is None else where[inner]
            start = self._rank(bits, ranks, start)
            stop = start + len(inner)
        return out


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text and write the file images in ascending doc_id order below ``path``.

    The documents are dealt out by ranges of doc_id and sorted within each; a row of the written
    table is one image: its range, its place in it, the documents' ids and sizes, and ``codes``.
    Spark's own writer commits the files, so a lost executor leaves none half-written. Null
    texts are empty (the end id alone); rows with a null doc_id come first; repeated rows are
    all written, next to each other.
    """
    rows = pick(docs, doc_id="long", text="string")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []
        seq = part = total = 0

        def image() -> pa.RecordBatch:
            ids = np.concatenate(held) if held else np.empty(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack_codes(ids)], pa.binary())],
                names=["part", "seq", "n_ids", "doc_ids", "sizes", "codes"],
            )

        for batch in batches:
            doc_ids, col, parts = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            part = parts[0].as_py() if len(parts) else part
            for lo in range(0, len(col), 512):
                texts = [x or "" for x in col.slice(lo, 512).to_pylist()]
                for a, b in chunks(texts):
                    ids, n = encode(texts[a:b])
                    ends = np.cumsum(n)
                    full = np.insert(ids, ends, end_id)
                    held.append(full.astype(np.uint32, copy=False))
                    names += doc_ids[lo + a : lo + b]
                    sizes += (n + 1).tolist()
                    total += len(full)
                    if total >= SHARD_IDS:
                        yield image()
                        held, names, sizes, total, seq = [], [], [], 0, seq + 1
        if names:
            yield image()

    dealt.mapInArrow(run, _IMAGE).write.parquet(path)


_IMAGE = "part int, seq int, n_ids long, doc_ids array<long>, sizes array<long>, codes binary"


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32 and perhaps ids.

    start counts the ids of all documents before it: images' sizes are summed within a range,
    then over ranges, whose number does not grow with the data.
    """
    images = spark.read.schema(_IMAGE).parquet(path)
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = images.select("part", "seq", "n_ids").withColumn("inner", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)))
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = images.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("outer", F.coalesce(F.sum("n").over(outer), F.lit(0))).select("part", "outer")
    base = before.join(ranges, "part").select("part", "seq", (F.col("inner") + F.col("outer")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, seq, _, doc_ids, sizes, image = (batch.column(i)[k].as_py() for i in range(6))
                codes = Codes(image)
                ends = np.cumsum(np.array(sizes, dtype=np.int64))
                starts = ends - np.array(sizes, dtype=np.int64)
                n = len(doc_ids)
                for lo in range(0, n, 20_000):
                    hi = min(n, lo + 20_000)
                    ids = [codes.slice(a, b) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                    cols = [pa.array([part] * (hi - lo), pa.int32()), pa.array([seq] * (hi - lo), pa.int32()), pa.array(doc_ids[lo:hi], pa.int64()), pa.array(starts[lo:hi]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                    names = ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = images.mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs_of(spark, sf_dir), vocabulary_path("word_bpe_49k.json"), path)
    return read_token_files(spark, path)
