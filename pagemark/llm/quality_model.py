"""Quality scores by kernel ridge regression on random Fourier features, calibrated isotonically."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, docs_of, fields, map_texts, materialise, pick

#: The fit reads at most this many labelled documents (those with the smallest hash of doc_id).
MAX_FIT = 12_000
FEATURES = 300
RIDGE = 1.0
WIDTH = 3.0
FOLDS = 5
THRESHOLD = 0.3
FIT_PARTITIONS = 6

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGITS = np.array([48 <= b <= 57 for b in range(256)])
_MARKS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_STOPS = np.array([chr(b) in ".,;:" for b in range(256)])
_CRIES = np.array([chr(b) in "!?" for b in range(256)])
_REST = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)]) & ~_MARKS & ~_STOPS & ~_CRIES


def statistics(text: str) -> list[float]:
    """Numbers that describe a text: sizes, shares of kinds of bytes, repetition, lines."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 20
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    lengths = np.fromiter(map(len, words), np.int64, n)
    p = count[count > 0] / size
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    threes = n - 2 - len(set(zip(words, words[1:], words[2:]))) if n > 2 else 0
    full = sum(x.rstrip()[-1:] in ".!?" for x in lines)
    return [
        math.log1p(n), float(lengths.mean()), float(lengths.std()), math.log1p(float(lengths.max())), float((lengths <= 3).mean()),
        math.log1p(count[_MARKS].sum() / n * 10), math.log1p(count[_CRIES].sum() / n * 10), math.log1p(count[_REST].sum() / n * 10), count[_STOPS].sum() / n,
        count[_UPPER].sum() / size, math.log1p(count[_DIGITS].sum() / n * 10), count[128:].sum() / size, float(-(p * np.log2(p)).sum()),
        len(set(words)) / n, threes / max(1, n - 2), math.log1p(len(lines)), (len(lines) - len(set(lines))) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), full / max(1, len(lines)),
        math.log1p(count[124] / n * 10),
    ]


def _signal(x: np.ndarray, model: dict) -> np.ndarray:
    """Random Fourier features of the standardised statistics, with the statistics and a one."""
    z = np.clip((x - model["mean"]) / model["std"], -8, 8)
    wave = np.cos(z @ model["w"] + model["b"]) * math.sqrt(2.0 / FEATURES)
    return np.hstack([wave, z / 4, np.ones((len(z), 1))])


def isotonic(score: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (places, values) of the non-decreasing fit of target on score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of targets, number, sum of scores
    for s, t in zip(score[order].tolist(), target[order].tolist()):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # One count of each kind is added to a block, so that no score is quite sure.
    return np.array([s / n for _, n, s in blocks]), np.array([(t + 0.5) / (n + 1) for t, n, _ in blocks])


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, by_class: bool = False) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` with a label to learn from, at most ``most`` of them.

    A document is held out if crc32 of its doc_id as text leaves ``held`` on division by
    ``modulus``. The sample takes the smallest hashes of doc_id, of each class apart if
    ``by_class`` is set; its size bounds what is sent to every executor.
    """
    rows = pick(labels, doc_id="long", **{label: "int"}).where(f"doc_id IS NOT NULL AND {label} IN (0, 1)")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")]
    if by_class:
        chosen = rows.where("y = 1").orderBy(*order).limit(most).union(rows.where("y = 0").orderBy(*order).limit(most))
    else:
        chosen = rows.orderBy(*order).limit(most)
    return pick(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model, or None without labelled rows of both kinds.

    Statistics of at most MAX_FIT labelled rows go to a scratch table. Each of a few partitions
    sums its part of the normal equations of every fold; the sums are added on the driver, and
    ridge weights are solved for all rows and for all but each fold. The left-out scores of the
    rows give the isotonic curve.
    """
    spark = docs.sparkSession
    rows = map_texts(labelled(docs, labels, "quality", 5, 0, MAX_FIT), lambda texts: {"x": [statistics(t) for t in texts]}, fields(x="array<double>"))
    rows = materialise(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLDS)).cast("int")), "quality-fit")
    size = len(statistics(""))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *[f(F.get("x", F.lit(i))).alias(f"{k}{i}") for i in range(size) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not seen["n"] or not 0 < seen["y"] < seen["n"]:
        discard(spark, rows)
        return None
    rng = np.random.default_rng(7)
    model = {"mean": np.array([seen[f"m{i}"] for i in range(size)]), "std": np.array([max(seen[f"s{i}"], 1e-3) for i in range(size)])}
    model["w"] = rng.normal(size=(size, FEATURES)) / WIDTH
    model["b"] = rng.uniform(0, 2 * math.pi, FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + size + 1
        total = np.zeros((FOLDS, d, d + 1))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                y, fold = batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy()
                z = _signal(x, model)
                for k in range(FOLDS):
                    zk = z[fold == k]
                    total[k] += zk.T @ np.hstack([zk, y[fold == k, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part"])

    parts = rows.select("x", "y", "fold").coalesce(FIT_PARTITIONS).mapInArrow(sums, "part binary").collect()
    d = FEATURES + size + 1
    total = sum(np.frombuffer(r["part"], "<f8").reshape(FOLDS, d, d + 1) for r in parts)
    solve = lambda m: np.linalg.solve(m[:, :d] + RIDGE * np.eye(d), m[:, d])
    model["beta"] = solve(total.sum(axis=0))
    out = np.array([solve(total.sum(axis=0) - total[k]) for k in range(FOLDS)])

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                s = (_signal(x, model) * out[batch.column(2).to_numpy()]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(1)], names=["s", "y"])

    pairs = rows.select("x", "y", "fold").coalesce(FIT_PARTITIONS).mapInArrow(left_out, "s double, y int").collect()
    s, y = (np.array([r[k] for r in pairs], dtype=float) for k in ("s", "y"))
    model["at"], model["value"] = isotonic(s, y)
    discard(spark, rows)
    return model


def score(texts: list[str], model: dict | None) -> list[float]:
    if model is None:
        return [0.5] * len(texts)
    s = _signal(np.array([statistics(t) for t in texts]), model) @ model["beta"]
    return np.clip(np.interp(s, model["at"], model["value"]), 0.0, 1.0).tolist()


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts count as texts without words, and are scored like any other. Null
    doc_ids are not held out; repeated rows are scored each. Without labels of both kinds every
    score is 0.5. Other columns are ignored, and none but the text enters a score.
    """
    model = fit(docs, labels)
    scored = map_texts(pick(docs, doc_id="long", text="string"), lambda texts: {"score": score(texts, model)}, fields(score="double"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "labels"))
