"""Toxicity scores by a bidirectional gated recurrent network with attention, in numpy.

A text is cut into overlapping windows of words. Each word enters as an embedding of itself, the
mean of embeddings of its runs of characters, and two numbers that say how telling the word and
its runs are among the labelled texts; two gated recurrent layers read the window forward and
backward, attention pools their states, and a text's score is that of its worst window. All is
learnt from labelled texts only; a text that is learnt from does not count for its own words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_place, discard, docs_of, fields, held, map_texts, materialise, pick
from .quality_model import labelled
from .tokens import ragged

#: The fit reads at most this many labelled documents of each class (smallest hashes of doc_id).
MAX_FIT = 2_000
WINDOW, STRIDE = 32, 16
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 14
#: Lengths of the runs of bytes that describe a word.
GRAMS = (3, 5, 7)
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 6, 12, 8, 8
BATCH, ROUNDS, LEARNING_RATE = 128, 2, 0.01
STEPS = (260, 200)
#: Share of words that a training step knows by their characters alone.
UNKNOWN = 0.6
DECAY = 0.3
THRESHOLD = 0.7
#: Distinct words kept in one worker.
MAX_WORDS = 120_000
#: Buckets of the counts of texts that have a word, or a run of characters but the shortest ones.
TELLING = 1 << 17

_EDGE = "'\"()[]{}<>.,;:!?-_*#$%&|/\\"


def window_starts(n: int) -> list[int]:
    """Starts of the windows of ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def clean(word: str) -> str:
    return word.strip(_EDGE) or word


# -- words to inputs --------------------------------------------------------------------------


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the words, of their runs one after another, how many runs each word has).

    The runs of a word are those of GRAMS bytes in it, its edges marked; a run's number modulo
    four is the place of its length in GRAMS.
    """
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    buckets = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw) + bytes(max(GRAMS)), np.uint8).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(size)[:-1])) if len(raw) else np.empty(0, np.int64)
    parts, owners = [], []
    for place, gram in enumerate(GRAMS):
        n = np.maximum(size - gram + 1, gram == GRAMS[0])  # the shortest runs are there for every word
        at = ragged(starts, n)
        h = np.full(len(at), gram, dtype=np.uint64)
        for k in range(gram):
            h = (h + text[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        parts.append(((h ^ h >> np.uint64(32)) & np.uint64((1 << 40) - 1)).astype(np.int64) * 4 + place)
        owners.append(np.repeat(np.arange(len(raw)), n))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return buckets, np.concatenate(parts)[order], np.bincount(owner, minlength=len(raw))


class Evidence:
    """In how many labelled texts of each class the words and runs of characters occur.

    Each is counted in two tables by different hashes, and the lesser value is believed, so that
    a word that shares one bucket with a telling one tells nothing.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        #: counts[class, two tables for words and two for runs, bucket]; sizes[class] texts.
        self.counts, self.sizes = counts, sizes

    @staticmethod
    def of(texts: list[str], labels: list[int]) -> Evidence:
        out = Evidence(np.zeros((2, 4, TELLING), np.int32), np.zeros(2, np.int64))
        for text, y in zip(texts, labels):
            words = list({clean(w) for w in text.lower().split()})
            out.sizes[y] += 1
            if words:
                buckets, chars, _ = word_inputs(words)
                for kind, numbers in ((0, buckets), (2, chars[chars % 4 > 0])):
                    for table, places in enumerate(out.places(numbers)):
                        out.counts[y, kind + table, np.unique(places)] += 1
        return out

    @staticmethod
    def places(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        return (mixed % np.uint64(TELLING)).astype(np.int64), ((mixed >> np.uint64(19)) % np.uint64(TELLING)).astype(np.int64)

    def tells(self, kind: int, numbers: np.ndarray, own: int | None = None) -> np.ndarray:
        """Signed square roots of the likelihood ratio that classes differ in a bucket; in [-2, 3].

        ``own`` is the class of the text that the words stand in, which is left out.
        """
        sizes = np.maximum(self.sizes - np.array([own == 0, own == 1]), 1)
        share = sizes[1] / sizes.sum()
        out = None
        for table, places in enumerate(self.places(numbers)):
            n, t = (self.counts[y, kind + table, places].astype(np.float64) - (own == y) for y in (0, 1))
            m = t + n
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(t > 0, t * np.log(t / (m * share)), 0) + np.where(n > 0, n * np.log(n / (m * (1 - share))), 0)
            z = np.where(t > m * share, 1, -1) * np.sqrt(np.maximum(2 * g, 0))
            out = z if out is None else np.minimum(out, z)
        return (np.clip(out, -8, 12) / 4).astype(np.float32)

    def features(self, inputs, own: int | None = None) -> np.ndarray:
        """For each word, what it tells, and the most that any of its longer runs tells."""
        numbers, chars, n = inputs
        told = np.full(len(chars), -np.inf, np.float32)
        long = np.flatnonzero(chars % 4 > 0)
        told[long] = self.tells(2, chars[long], own)
        runs = np.maximum.reduceat(told, np.cumsum(n) - n)
        return np.stack([self.tells(0, numbers, own), np.where(np.isfinite(runs), runs, 0)], axis=1)


class Network:
    """The parameters, and the passes forward and backward over windows of equal length."""

    SHAPES = {
        "word": (WORD_BUCKETS + 1, WORD_DIM), "char": (CHAR_BUCKETS, CHAR_DIM),
        **{f"{p}{d}": s for d in "fb" for p, s in (("W", (WORD_DIM + CHAR_DIM + 2, 3 * HIDDEN)), ("c", (3 * HIDDEN,)), ("U", (HIDDEN, 3 * HIDDEN)))},
        "A": (2 * HIDDEN, ATTENTION), "a": (ATTENTION,), "w": (2 * HIDDEN,), "bias": (1,),
    }

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(size=s) * (0.05 if k in ("word", "char") else 1 / math.sqrt(s[0]))).astype(np.float32) for k, s in self.SHAPES.items()}
        for k in ("cf", "cb", "bias"):
            self.p[k][:] = 0
        self.p["word"][WORD_BUCKETS] = 0  # a word not known
        self.slow = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.fast = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def embed(self, inputs) -> np.ndarray:
        buckets, chars, n, *telling = inputs
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        mean = np.add.reduceat(self.p["char"][chars % CHAR_BUCKETS], starts, axis=0) / n[:, None].astype(np.float32)
        return np.hstack([self.p["word"][self._row(buckets)], mean, telling[0] if telling else np.zeros((len(n), 2), np.float32)])

    @staticmethod
    def _row(buckets: np.ndarray) -> np.ndarray:
        """The row of a word's embedding; the last one is that of words not known (-1)."""
        return np.where(buckets < 0, WORD_BUCKETS, buckets % WORD_BUCKETS)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a word adds to the gates of each direction; computed once a word."""
        return x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]

    def _read(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool):
        n, length = index.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((length, n, HIDDEN), np.float32)
        trace = []
        whole = bool(mask.all())
        for t in range(length)[:: -1 if back else 1]:
            g = gates[index[:, t]]
            s = h @ u
            rz = g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if not whole:
                new *= mask[:, t, None]
            if keep:
                trace.append((h, r, z, c, s[:, 2 * HIDDEN :]))
            states[t] = h = new
        return states, trace

    def forward(self, gates, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """The logit of each window."""
        p = self.p
        f, tf = self._read(gates[0], index, mask, p["Uf"], False, keep)
        b, tb = self._read(gates[1], index, mask, p["Ub"], True, keep)
        h = np.concatenate([f, b], axis=2)
        q = np.tanh(h.reshape(-1, 2 * HIDDEN) @ p["A"])
        e = (q @ p["a"]).reshape(h.shape[:2])
        e = np.where(mask.T > 0, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", e, h)
        logit = pooled @ p["w"] + p["bias"][0]
        return logit, (h, q, e, pooled, tf, tb) if keep else None

    def _unread(self, d_states, trace, index, mask, u, back, d_gates):
        du = np.zeros_like(u)
        dh = np.zeros_like(d_states[0])
        order = list(range(index.shape[1]))[:: -1 if back else 1]
        for t, (h, r, z, c, sc) in zip(order[::-1], trace[::-1]):
            d = (dh + d_states[t]) * mask[:, t, None]
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * sc * r * (1 - r)
            d_gates[t] = np.hstack([dr, dz, dc])
            ds = np.hstack([dr, dz, dc * r])
            du += h.T @ ds
            dh = d * z + ds @ u.T
        return du

    def learn(self, inputs, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """One step of Adam on the logistic loss of a batch; the loss."""
        p = self.p
        x = self.embed(inputs)
        gates = self.gates(x)
        logit, (h, q, e, pooled, tf, tb) = self.forward(gates, index, mask, keep=True)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = float(-(weight * np.log(np.where(y > 0, prob, 1 - prob) + 1e-7)).sum() / weight.sum())
        dl = ((prob - y) * weight / weight.sum()).astype(np.float32)
        g = {"bias": np.array([dl.sum()]), "w": pooled.T @ dl}
        dp = dl[:, None] * p["w"]
        dh = e[:, :, None] * dp
        de = np.einsum("tnh,nh->tn", h, dp)
        de = e * (de - (e * de).sum(axis=0))
        dq = de.reshape(-1, 1) * p["a"] * (1 - q * q)
        g["a"] = q.T @ de.reshape(-1)
        flat = h.reshape(-1, 2 * HIDDEN)
        g["A"] = flat.T @ dq
        dh += (dq @ p["A"].T).reshape(h.shape)
        dx = np.zeros_like(x)
        for d, back, trace, part in (("f", False, tf, dh[:, :, :HIDDEN]), ("b", True, tb, dh[:, :, HIDDEN:])):
            d_gates = np.zeros((index.shape[1], len(index), 3 * HIDDEN), np.float32)
            g[f"U{d}"] = self._unread(part, trace, index, mask, p[f"U{d}"], back, d_gates)
            dg = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(dg, index.T.reshape(-1), d_gates.reshape(-1, 3 * HIDDEN))
            g[f"W{d}"], g[f"c{d}"] = x.T @ dg, dg.sum(axis=0)
            dx += dg @ p[f"W{d}"].T
        buckets, chars, n = inputs[:3]
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], self._row(buckets), dx[:, :WORD_DIM])
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], chars % CHAR_BUCKETS, np.repeat(dx[:, WORD_DIM : WORD_DIM + CHAR_DIM] / n[:, None].astype(np.float32), n, axis=0))
        self.t += 1
        for k, v in g.items():
            v = v.astype(np.float32)
            self.slow[k] += 0.1 * (v - self.slow[k])
            self.fast[k] += 0.01 * (v * v - self.fast[k])
            step = LEARNING_RATE * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            p[k] -= step * self.slow[k] / (np.sqrt(self.fast[k]) + 1e-6)
            if k in ("word", "char"):
                p[k] *= 1 - DECAY * LEARNING_RATE
        return loss


class Reader:
    """Scores texts with a network; inputs of distinct words are kept between batches."""

    def __init__(self, parameters: dict[str, np.ndarray], evidence: Evidence, own: int | None = None):
        self.net = Network.__new__(Network)
        self.net.p, self.evidence, self.own = parameters, evidence, own
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        # Row 0 stands for no word.
        self.gates = [np.zeros((1, 3 * HIDDEN), np.float32)] * 2

    def numbers(self, texts: list[str]) -> list[list[int]]:
        if len(self.words) > MAX_WORDS:
            self.clear()
        known, fresh, out = self.words, [], []
        for text in texts:
            row = []
            for w in text.lower().split():
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known) + 1
                    fresh.append(w)
                row.append(k)
            out.append(row)
        if fresh:
            inputs = word_inputs([clean(w) for w in fresh])
            new = self.net.gates(self.net.embed((*inputs, self.evidence.features(inputs, self.own))))
            self.gates = [np.concatenate([a, b]) for a, b in zip(self.gates, new)]
        return out

    def window_logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window and the number of windows of each text."""
        rows = self.numbers(texts)
        starts = [window_starts(len(r)) for r in rows]
        count = np.fromiter(map(len, starts), np.int64, len(rows))
        total = int(count.sum())
        index = np.zeros((total, WINDOW), np.int64)
        at = 0
        for r, s in zip(rows, starts):
            if len(r) >= WINDOW:
                a = np.array(r, dtype=np.int64)
                index[at : at + len(s)] = a[np.array(s)[:, None] + np.arange(WINDOW)]
            elif r:
                index[at, : len(r)] = r
            at += len(s)
        logits = np.empty(total, np.float32)
        full = index[:, -1] > 0
        for group in (np.flatnonzero(full), np.flatnonzero(~full)):
            for lo in range(0, len(group), 2048):
                some = group[lo : lo + 2048]
                part = index[some]
                logits[some] = self.net.forward(self.gates, part, (part > 0).astype(np.float32))[0]
        return logits, count

    def worst(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, its highest logit and that window's number; -inf and -1 for no words."""
        logits, count = self.window_logits(texts)
        best, which = np.full(len(texts), -np.inf, np.float32), np.full(len(texts), -1, np.int64)
        has = np.flatnonzero(count)
        if len(has):
            starts = (np.cumsum(count) - count)[has]
            best[has] = np.maximum.reduceat(logits, starts)
            for k, s in zip(has.tolist(), starts.tolist()):
                which[k] = int(np.argmax(logits[s : s + count[k]]))
        return best, which


# -- fitting ----------------------------------------------------------------------------------


def _gathered(sample: DataFrame) -> Evidence:
    """The evidence of ``sample(text, y)``: one table a partition, of a fixed size, is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Evidence.of([], [])
        for batch in batches:
            part = Evidence.of([t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist())
            total = Evidence(total.counts + part.counts, total.sizes + part.sizes)
        yield pa.RecordBatch.from_arrays([pa.array([total.counts.tobytes()], pa.binary()), pa.array([total.sizes.tobytes()], pa.binary())], names=["c", "s"])

    total = Evidence.of([], [])
    for r in sample.select("text", "y").coalesce(4).mapInArrow(run, "c binary, s binary").toLocalIterator():
        total.counts += np.frombuffer(r["c"], np.int32).reshape(total.counts.shape)
        total.sizes += np.frombuffer(r["s"], np.int64)
    return total


def _chosen(sample: DataFrame, pick_windows) -> list[tuple[int, int, list[str]]]:
    """(doc_id, label, words) of the windows that ``pick_windows(texts, labels)`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, texts, ys = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()], part.column(2).to_pylist()
                out = []
                for k, starts in enumerate(pick_windows(ids, texts, ys)):
                    words = texts[k].lower().split()
                    out += [(ids[k], ys[k], " ".join(words[s : s + WINDOW])) for s in starts]
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["doc_id", "y", "words"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, words string").collect()
    return [(r["doc_id"], r["y"], [clean(w) for w in r["words"].split()]) for r in sorted(rows)]


def _spread(doc_id: int, n: int, k: int) -> list[int]:
    """k of n windows, by a hash of the document."""
    return [zlib.crc32(f"{doc_id}:{i}".encode()) % n for i in range(k)] if n else []


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The network and its calibration, or None without labelled rows of both kinds.

    Labels tell of whole texts. The first windows of a toxic text are those with the most
    telling words; after training, its windows are chosen anew by the network, and the worst
    windows of clean texts are added to the random ones. A fifth of the texts is kept from
    training, and all are scored for the calibration. Samples are bounded by MAX_FIT, windows by a few a text.
    """
    spark = docs.sparkSession
    sample = materialise(labelled(docs, labels, "toxic", 3, 1, MAX_FIT, by_class=True).repartition(12), "toxic-fit")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        discard(spark, sample)
        return None
    train, kept = (sample.where(f"pmod(xxhash64(doc_id, 5), 5) {op} 0") for op in ("<>", "="))
    evidence = spark.sparkContext.broadcast(_gathered(train))

    def first(ids, texts, ys):
        for name, text, y in zip(ids, texts, ys):
            words = [clean(w) for w in text.lower().split()]
            starts = window_starts(len(words))
            tell = evidence.value.features(word_inputs(words), y).max(axis=1) if words else np.empty(0)
            value = np.array([tell[s : s + WINDOW].max() for s in starts]) if starts else np.empty(0)
            top = np.argsort(-value, kind="stable")[: 3 if y else 1].tolist()
            yield [starts[i] for i in dict.fromkeys(top if y else top + _spread(name, len(starts), 3))]

    net = Network()
    windows = _chosen(train, first)
    for turn in range(ROUNDS):
        if turn:
            shared = {k: v.copy() for k, v in net.p.items()}

            def again(ids, texts, ys, shared=shared):
                out: list = [None] * len(ids)
                for label in (0, 1):
                    some = [k for k, y in enumerate(ys) if y == label]
                    logits, count = _reader(shared, evidence.value, label).window_logits([texts[k] for k in some])
                    at = 0
                    for k, n in zip(some, count.tolist()):
                        starts = window_starts(len(texts[k].lower().split()))
                        top = np.argsort(-logits[at : at + n], kind="stable")[:2].tolist()
                        at += n
                        out[k] = [starts[i] for i in dict.fromkeys(top if label else top + _spread(ids[k], n, 2))]
                return out

            windows = _chosen(train, again) + [w for w in windows if not w[1]]
        _train(net, evidence.value, windows, STEPS[turn], seed=turn)
    parameters = net.p

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y, own = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_numpy(), batch.column(2).to_numpy()
            s = np.empty(len(texts))
            for kind in np.unique(own).tolist():
                some = np.flatnonzero(own == kind)
                s[some] = np.maximum(_reader(parameters, evidence.value, None if kind < 0 else kind).worst([texts[k] for k in some])[0], -30)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(y)], names=["s", "y"])

    # Texts that were learnt from count as well, without their own evidence.
    known = kept.select("text", "y", F.lit(-1).alias("own")).union(train.select("text", "y", F.col("y").alias("own")))
    rows = known.mapInArrow(worst, "s double, y int").collect()
    share = labels_share(labels)
    slope, shift = _platt(np.array([r["s"] for r in rows]), np.array([r["y"] for r in rows], dtype=float), share)
    discard(spark, sample)
    return {"p": parameters, "evidence": evidence.value, "slope": slope, "shift": shift}


def labels_share(labels: DataFrame) -> float:
    """The share of toxic rows among those to learn from; the sample takes equal parts."""
    rows = pick(labels, doc_id="long", toxic="int").where("toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    share = rows.agg(F.avg("toxic").alias("m")).first()["m"]
    return min(0.9, max(0.01, share if share is not None else 0.5))


def _train(net: Network, evidence: Evidence, windows: list[tuple[int, int, list[str]]], steps: int, seed: int) -> None:
    # A word of a toxic text and that of a clean one are two, since a text does not tell of its own.
    words = sorted({(y, w) for _, y, ws in windows for w in ws})
    number = {w: k for k, w in enumerate(words)}
    buckets, chars, n = word_inputs([w for _, w in words])
    starts = np.cumsum(n) - n
    telling = np.empty((len(words), 2), np.float32)
    for label in (0, 1):
        some = np.array([k for k, (y, _) in enumerate(words) if y == label], dtype=np.int64)
        if len(some):
            telling[some] = evidence.features((buckets[some], chars[ragged(starts[some], n[some])], n[some]), label)
    index = np.full((len(windows), WINDOW), -1, np.int64)
    for k, (_, label, ws) in enumerate(windows):
        index[k, : len(ws)] = [number[label, w] for w in ws]
    y = np.array([w[1] for w in windows], dtype=np.float32)
    rng = np.random.default_rng(seed)
    pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    if not len(pos) or not len(neg):
        return
    for _ in range(steps):
        some = np.concatenate([rng.choice(pos, BATCH // 2), rng.choice(neg, BATCH // 2)])
        part = index[some]
        used, inner = np.unique(part, return_inverse=True)
        inner = inner.reshape(part.shape)
        if used[0] < 0:
            used = used[1:]
            inner = inner - 1
        mask = (part >= 0).astype(np.float32)
        known = np.where(rng.random(len(used)) < UNKNOWN, -1, buckets[used])
        inputs = known, chars[ragged(starts[used], n[used])], n[used], telling[used]
        net.learn(inputs, np.maximum(inner, 0), mask, y[some], np.ones(len(some), np.float32))


def _platt(s: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, towards the natural share of classes."""
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(x: np.ndarray) -> float:
        m = x[0] * s + x[1]
        return float((weight * (np.logaddexp(0, m) - target * m)).sum() + 0.005 * (x[0] - 1) ** 2 + 0.0005 * x[1] ** 2)

    x = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x[0] * s + x[1], -30, 30)))
        g = np.array([(weight * (p - target) * s).sum() + 0.01 * (x[0] - 1), (weight * (p - target)).sum() + 0.001 * x[1]])
        v = weight * p * (1 - p)
        h = np.array([[(v * s * s).sum() + 0.01, (v * s).sum()], [(v * s).sum(), v.sum() + 0.001]])
        step, now = np.linalg.solve(h, g), loss(x)
        while np.abs(step).max() > 1e-9 and loss(x - step) > now:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        x = x - step
    return max(float(x[0]), 0.05), float(x[1])


# -- scoring ----------------------------------------------------------------------------------


def _reader(parameters: dict[str, np.ndarray], evidence: Evidence, own: int | None = None) -> Reader:
    """This worker's reader; kept between tasks with the same network."""
    key = zlib.crc32(b"".join(parameters[k].tobytes() for k in sorted(parameters)))
    return held(("reader", key, own), lambda: Reader(parameters, evidence, own))


def score(texts: list[str], model: dict | None) -> list[float]:
    if model is None:
        return [0.0] * len(texts)
    best, _ = _reader(model["p"], model["evidence"]).worst(texts)
    p = 1 / (1 + np.exp(-np.clip(model["slope"] * np.maximum(best, -30).astype(float) + model["shift"], -30, 30)))
    return np.where(np.isfinite(best), p, 0.0).tolist()


def _scorer(docs: DataFrame, labels: DataFrame):
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda texts: score(texts, shared.value)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts have no windows and score 0. Null doc_ids are not held out; repeated
    rows are scored each. Without labels of both kinds every score is 0. Other columns are
    ignored, and none but the text enters a score.
    """
    scorer = _scorer(docs, labels)
    scored = map_texts(pick(docs, doc_id="long", text="string"), lambda texts: {"score": scorer(texts)}, fields(score="double"))
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", apart.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Null and empty texts score 0 and stay, as all rows do without labels of both kinds. Repeated
    rows are judged each; an empty table stays empty. Columns of any name pass through.
    """
    placed, at = by_place(docs)
    if "text" not in at:
        return docs
    scorer = _scorer(docs, labels)
    scored = map_texts(placed, lambda texts: {"__pm_toxic": scorer(texts)}, fields(__pm_toxic="double"), column=at["text"], keep=True)
    return scored.where(F.col("__pm_toxic") < threshold).select(*placed.columns).toDF(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "labels"))
