"""Near-duplicates: SimHash by tiled exact comparison of fingerprints.

Fingerprints meet in pairs of tiles, are compared by exclusive-or and bit counts, and tiles whose
counts of set bits are too far apart are skipped. ``op1_simhash`` is the contract on 64 bits. The
pipeline's ``near_dedup`` groups sets that share a band of minima, compares fingerprints of 512
bits within groups, wide enough to tell a Jaccard of 0.8 apart, and confirms each link on the
whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_place, discard, docs_of, fields, map_texts, materialise, pick, small_batches
from .components import connected_components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: For each byte, its bits as eight byte counters in one 64-bit word (lowest bit first).
_SPREAD = np.array([int.from_bytes(bytes(b >> k & 1 for k in range(8)), "little") for b in range(256)], dtype=np.uint64)
#: Largest number of fingerprints in a tile; both tiles of a pair sit in one task.
MAX_TILE = 1 << 18
#: Tiles aimed at while a tile is smaller than that.
AIM_TILES = 48
ROWS_AT_ONCE = 32
#: A fingerprint of more than one in this many rows is joined apart; there are fewer than this.
HOT = 256


def fingerprints(texts: list[str], words: int = 4) -> list[int]:
    """The SimHash of each text, as a signed 64-bit integer."""
    hashed: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not parts:
            continue
        if len(parts) <= words:
            hashed.append(digest(b" ".join(parts), 42))
            counts[k] = 1
            continue
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-words] + 1))
        stops = ends[words - 1 :]
        hashed.extend([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())])
        counts[k] = len(stops)
    return majority(np.array(hashed, dtype="<u8"), counts).view(np.int64).tolist()


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of ``counts[k]`` hashes, the bits that over half of them have; 0 for an empty run."""
    if not len(h):
        return np.zeros(len(counts), dtype=np.uint64)
    # Groups of at most 255 hashes of one text, so that a byte counter cannot overflow.
    groups = (counts + 254) // 255
    owner = np.repeat(np.arange(len(counts)), groups)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    start = first[owner] + 255 * (np.arange(len(owner)) - np.concatenate(([0], np.cumsum(groups)[:-1]))[owner])
    sums = np.empty((len(owner), 64), dtype=np.uint8)
    for byte in range(8):
        wide = _SPREAD[h.view(np.uint8)[byte::8]]
        sums[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(wide, start).astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.zeros((len(counts), 64), dtype=np.int64)
    np.add.at(total, owner, sums)
    bits = (2 * total > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)


def with_fingerprint(docs: DataFrame, words: int = 4, column: str = "fp") -> DataFrame:
    """``docs`` without ``text`` and with the fingerprint; null text counts as empty (zero)."""
    return map_texts(docs, lambda texts: {column: fingerprints(texts, words)}, fields(**{column: "long"}))


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``a`` and ``b`` (within ``a`` if ``same``).

    All pairs are compared, rows of ``a`` against stretches of ``b`` whose counts of bits in the
    high half can still be within the radius; only links that join two trees are kept.
    """
    half = np.uint64(32)
    a, b = (x[np.argsort(np.bitwise_count(x >> half), kind="stable")] for x in (a, b))
    high_a, high_b = (np.bitwise_count(x >> half).astype(np.int64) for x in (a, b))
    low_a, low_b = (np.bitwise_count(x).astype(np.int64) - h for x, h in ((a, high_a), (b, high_b)))
    lo_b, hi_b = int(low_b.min()), int(low_b.max())
    parent = np.arange(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    wide = np.empty((ROWS_AT_ONCE, 8192), dtype=np.uint64)
    count = np.empty((ROWS_AT_ONCE, 8192), dtype=np.uint8)
    for i in range(0, len(a), ROWS_AT_ONCE):
        rows = a[i : i + ROWS_AT_ONCE]
        h0, h1 = high_a[i], high_a[min(i + ROWS_AT_ONCE, len(a)) - 1]
        gap = max(0, lo_b - int(low_a[i : i + ROWS_AT_ONCE].max()), int(low_a[i : i + ROWS_AT_ONCE].min()) - hi_b)
        if gap > radius:
            continue
        start = int(np.searchsorted(high_b, h0 - (radius - gap), "left"))
        stop = int(np.searchsorted(high_b, h1 + (radius - gap), "right"))
        if same:
            start = max(start, i)
        for j in range(start, stop, 8192):
            cols = b[j : min(j + 8192, stop)]
            x, c = wide[: len(rows), : len(cols)], count[: len(rows), : len(cols)]
            np.bitwise_xor(rows[:, None], cols[None, :], out=x)
            np.bitwise_count(x, out=c)
            if c.min() > radius:
                continue
            for p, q in zip(*(w.tolist() for w in np.nonzero(c <= radius))):
                s, t = root(i + p), root(shift + j + q)
                if s != t:
                    parent[max(s, t)] = min(s, t)
                    links.append((i + p, j + q))
    if not links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    u, v = np.array(links).T
    return a[u], b[v]


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v): enough of the links at ``radius`` bits or fewer to connect all that they connect.

    ``nodes(fp)`` holds each fingerprint once. Fingerprints are put into tiles by their number
    of set bits, with sub-tiles where a tile would be large; every pair of tiles that can hold
    a link meets in one group, and others are skipped. A group returns a spanning forest of its
    links, so a large bunch of near copies makes no quadratic output. Only the 65 counts of
    fingerprints by bit number reach the driver.
    """
    counted = nodes.withColumn("p", F.bit_count("fp").cast("int"))
    sizes = {r["p"]: r["n"] for r in counted.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    tile = max(1, min(MAX_TILE, -(-total // AIM_TILES)))
    subs = [-(-sizes.get(p, 0) // tile) for p in range(65)]
    lit = "array(" + ",".join(map(str, subs)) + ")"
    tiled = counted.selectExpr("fp", "p", f"cast(pmod(xxhash64(fp, 7), greatest({lit}[p], 1)) as int) AS s")
    mine = "p * 16777216L + s"
    # Partner tiles as p * 2^24 + s, at most ``radius`` bits apart; pair = ordered (tile, tile).
    partners = f"flatten(transform(sequence(greatest(p - {radius}, 0), least(p + {radius}, 64)), q -> transform(sequence(0, {lit}[q]), r -> if(r < {lit}[q], q * 16777216L + r, -1L))))"
    sent = tiled.selectExpr("fp", f"{mine} AS t", f"explode(filter({partners}, x -> x >= 0)) AS o").selectExpr("least(t, o) AS ta", "greatest(t, o) AS tb", "t", "fp")

    def kernel(key, table):  # no hints: Spark reads them
        ta, tb = key[0].as_py(), key[1].as_py()
        t = table.column("t").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        a = fp[t == ta]
        b = a if ta == tb else fp[t == tb]
        u, v = _forest(a, b, radius, ta == tb) if len(a) and len(b) else (a[:0], a[:0])
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return sent.groupBy("ta", "tb").applyInArrow(kernel, "u long, v long")


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text)``: (doc_id, fp, component_id), a row per row.

    component_id is the smallest doc_id reachable over links of ``radius`` bits or fewer.
    Null and empty texts (and those of white space) have fingerprint zero and link like any
    other. Rows with a null doc_id keep their place and take part; a class of such rows only has
    a null component_id. Repeated rows come back as often as they are given. An empty table
    gives an empty result. Other columns are ignored.
    """
    fps = materialise(with_fingerprint(pick(docs, doc_id="long", text="string"), words), "simhash")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    found = materialise(links(nodes.select("fp"), radius), "simhash-links")
    roots = materialise(connected_components(found, "simhash-cc"), "simhash-roots")
    discard(docs.sparkSession, found)
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    classes = linked.join(least, "root").select(F.col("node").alias("fp"), "least")
    named = materialise(nodes.join(classes, "fp", "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id")), "simhash-named")
    # A fingerprint with a good part of all rows would be one task's: there are few such, and
    # they are looked up in a table of at most HOT rows instead.
    total = named.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(1, total // HOT)
    rows = fps.join(F.broadcast(named.where(often).select("fp", F.lit(True).alias("hot"), F.col("component_id").alias("c"))), "fp", "left")
    some = rows.where("hot").select("doc_id", "fp", F.col("c").alias("component_id"))
    return some.union(rows.where("hot IS NULL").select("doc_id", "fp").join(named.where(~often), "fp").select("doc_id", "fp", "component_id"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(docs_of(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A near copy: as many of the two texts' distinct shingles are shared as NEAR says (4 of 5: Jaccard 0.8).
NEAR = (4, 5)
#: 64-bit words of a wide fingerprint.
WIDE = 8
#: Bits in which near copies' fingerprints differ at most: in the first word, and in all. At a
#: Jaccard of 0.8 a bit differs with chance 0.15 to 0.163, so these are at least 4.5 standard
#: deviations above the mean; for sets of up to TINY shingles (chance 0.188) there are wider ones.
TINY = 6
FIRST, RADIUS = (24, 27), (121, 140)
#: Steps of the radius: closer pairs are linked first, which are the likelier to be confirmed.
LEVELS = (0.5, 0.65, 0.8, 1.0)
#: Bands of minima and minima in a band: at a Jaccard of 0.8 two sets share no band with a chance
#: of (1 - 0.8^4)^28 = 4e-7.
BANDS, MINIMA = 28, 4
#: Largest number of sets in a tile, and largest sum of whole sets (one larger set goes alone).
WIDE_TILE, TILE_BYTES = 1 << 16, 32 << 20
#: Bytes of whole sets aimed at in a bin of smaller groups.
BIN_BYTES = 8 << 20
_MIX = np.random.default_rng(5).integers(0, 1 << 64, (2, WIDE), dtype=np.uint64) | np.uint64(1)
_ORDERS = np.random.default_rng(6).integers(0, 1 << 64, (2, BANDS * MINIMA), dtype=np.uint64) | np.uint64(1)


def shingles(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """The distinct hashed word shingles of each text, ascending; a shorter text is one shingle."""
    digest = xxhash.xxh64_intdigest
    out = []
    for text in texts:
        parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        joined = b" ".join(parts)
        if len(parts) <= words:
            hashed = [digest(joined, 42)] if parts else []
        else:
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
            starts = np.concatenate(([0], ends[:-words] + 1))
            hashed = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]
        out.append(np.unique(np.array(hashed, dtype=np.uint64)))
    return out


def set_keys(sets: list[np.ndarray]) -> list[int]:
    """A signed 64-bit name of each set of shingles."""
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], dtype=np.uint64).view(np.int64).tolist()


def wide_prints(sets: list[np.ndarray]) -> list[bytes]:
    """The SimHash of each set in WIDE words, from as many mixtures of its hashes."""
    counts = np.array([len(s) for s in sets], dtype=np.int64)
    every = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    out = np.empty((len(sets), WIDE), dtype=np.uint64)
    for k in range(WIDE):
        h = every * _MIX[0, k]
        h ^= h >> np.uint64(32)
        h *= _MIX[1, k]
        h ^= h >> np.uint64(29)
        out[:, k] = majority(h.astype("<u8", copy=False), counts)
    return [row.tobytes() for row in out]


def bands(sets: list[np.ndarray]) -> list[list[int]]:
    """For each set BANDS names, each made of the minima in MINIMA orders of its hashes; none for an empty set.

    Two sets have the same minimum in an order with a chance of their Jaccard.
    """
    out: list[list[int]] = [[] for _ in sets]
    there = [k for k, s in enumerate(sets) if len(s)]
    if not there:
        return out
    every = np.concatenate([sets[k] for k in there])
    counts = np.array([len(sets[k]) for k in there], dtype=np.int64)
    starts = np.cumsum(counts) - counts
    names = np.empty((len(there), BANDS), dtype=np.uint64)
    order = np.empty_like(every)
    for b in range(BANDS):
        name = np.full(len(there), b + 1, dtype=np.uint64)
        for k in range(b * MINIMA, (b + 1) * MINIMA):
            np.multiply(every, _ORDERS[0, k], out=order)
            name = (name ^ np.minimum.reduceat(order, starts)) * _ORDERS[1, k]
            name ^= name >> np.uint64(32)
        names[:, b] = name
    for k, row in zip(there, names.view(np.int64).tolist()):
        out[k] = row
    return out


def _close(a: np.ndarray, b: np.ndarray, first: int, above: int, radius: int, labels: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in ``a``, in ``b``) of pairs within both radii, over ``above`` bits apart, with different labels.

    ``labels`` are those of ``a`` and then those of ``b``, and may change between two results.
    Rows are in order of their number of set bits; stretches too far apart are passed over.
    """
    ones_a, ones_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    first_a, first_b = np.ascontiguousarray(a[:, 0]), np.ascontiguousarray(b[:, 0])
    shift = 0 if same else len(a)
    wide = np.empty((ROWS_AT_ONCE, 8192), dtype=np.uint64)
    count = np.empty((ROWS_AT_ONCE, 8192), dtype=np.uint8)
    for i in range(0, len(a), ROWS_AT_ONCE):
        rows = first_a[i : i + ROWS_AT_ONCE]
        start = int(np.searchsorted(ones_b, ones_a[i] - radius, "left"))
        stop = int(np.searchsorted(ones_b, ones_a[i + len(rows) - 1] + radius, "right"))
        for j in range(max(start, i) if same else start, stop, 8192):
            cols = first_b[j : min(j + 8192, stop)]
            x, c = wide[: len(rows), : len(cols)], count[: len(rows), : len(cols)]
            np.bitwise_xor(rows[:, None], cols[None, :], out=x)
            np.bitwise_count(x, out=c)
            if c.min() > first:
                continue
            p, q = np.nonzero(c <= first)
            p, q = p + i, q + j
            good = labels[p] != labels[shift + q]
            p, q = p[good], q[good]
            for lo in range(0, len(p), 65536):
                u, v = p[lo : lo + 65536], q[lo : lo + 65536]
                apart = np.bitwise_count(a[u] ^ b[v]).sum(axis=1, dtype=np.int64)
                near = (apart <= radius) & (apart > above)
                if near.any():
                    yield u[near], v[near]


def _wide_links(a: np.ndarray, b: np.ndarray, roots: np.ndarray, first: int, radius: int, same: bool, check: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs within the radii: a forest that spans what they connect beside equal ``roots``.

    ``check(p, qs)`` says which of the pairs are links; without it all are. Closer pairs come
    first, so a bunch is mostly linked before its further pairs would be looked at.
    """
    labels = np.unique(roots, return_inverse=True)[1]
    parent = np.arange(labels.max(initial=-1) + 1)
    shift = 0 if same else len(a)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []

    def link(u: np.ndarray, v: np.ndarray) -> None:
        before = len(out)
        for p, q in zip(u.tolist(), v.tolist()):
            s, t = top(labels[p]), top(labels[shift + q])
            if s != t:
                parent[max(s, t)] = min(s, t)
                out.append((p, q))
        if len(out) > before:
            while (parent != parent[parent]).any():
                parent[:] = parent[parent]
            labels[:] = parent[labels]

    above = -1
    for level in LEVELS:
        for u, v in _close(a, b, first, above, int(radius * level), labels, same):
            if check is None:
                link(u, v)
                continue
            order = np.argsort(u, kind="stable")
            u, v = u[order], v[order]
            for p, qs in zip(*(lambda x, at: (x.tolist(), np.split(v, at[1:])))(*np.unique(u, return_index=True))):
                qs = qs[labels[p] != labels[shift + qs]]
                if len(qs) and len(qs := qs[check(p, qs)]):
                    link(np.full(len(qs), p), qs)
        above = int(radius * level)
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 2).T)


def _alike(a: list[np.ndarray], b: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether the set ``a[p]`` has a Jaccard of NEAR or more with each ``b[q]``; sets ascend."""
    few, many = NEAR

    def check(p: int, qs: np.ndarray) -> np.ndarray:
        mine, others = a[p], [b[q] for q in qs.tolist()]
        sizes = np.fromiter(map(len, others), np.int64, len(others))
        every = np.concatenate(others)
        same = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
        shared = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)
        return shared * many >= (len(mine) + sizes - shared) * few

    return check


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, root): the groups that shared bands make of ``nodes(node, bands)``, without lone nodes.

    A band links each of its nodes to the smallest, so the links are at most BANDS a node,
    however many nodes share a band.
    """
    spark = nodes.sparkSession
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = materialise(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "hub"), "dedup-bands")
    star = materialise(banded.join(shared, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), "dedup-star")
    groups = materialise(connected_components(star, "dedup-group"), "dedup-groups")
    discard(spark, shared, star)
    return groups


def near_links(nodes: DataFrame) -> DataFrame:
    """(u, v), u the greater: a forest of the near copies among ``nodes(node, n, bits, items, grp)`` of a group.

    Each set goes to one bin, with all of its group, and is sent once. Only a group above
    WIDE_TILE sets or TILE_BYTES is cut into tiles: sets whose sizes differ by more than a
    quarter cannot reach NEAR, so its sets are put into tiles by the logarithm of their size,
    bounded in rows and bytes, and meet those of the sizes next to theirs. There are few such
    groups (less than the bytes of all sets over TILE_BYTES, or sets over WIDE_TILE). Two tiles
    give enough links to connect all that they connect.
    """
    few, many = NEAR
    names = ["node", "n", "bits", "items"]
    sized = nodes.where("n > 0").select("grp", *names, F.floor(F.log(F.col("n").cast("double")) / float(np.log(many / few))).cast("int").alias("p"))
    sizes = sized.groupBy("grp", "p").agg(F.count(F.lit(1)).alias("k"), F.sum(8 * F.col("n")).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bins = max(1, -(-total // BIN_BYTES))
    tiles = F.collect_list(F.expr(f"struct(p, cast(ceil(greatest(k / {WIDE_TILE}, bytes / {TILE_BYTES})) as int) AS m)"))
    large = sizes.groupBy("grp").agg(F.sum("k").alias("k"), F.sum("bytes").alias("bytes"), tiles.alias("tiles")).where(f"k > {WIDE_TILE} OR bytes > {TILE_BYTES}").select("grp", "tiles")
    placed = sized.join(F.broadcast(large), "grp", "left").withColumn("m", F.expr("filter(tiles, x -> x.p = p)[0].m"))
    placed = placed.selectExpr(*names, "p", "tiles", f"if(tiles IS NULL, pmod(xxhash64(grp), {bins}), grp) AS g", "if(tiles IS NULL, -1L, p * 16777216L + pmod(xxhash64(node, 7), m)) AS t")
    partners = "flatten(transform(filter(tiles, x -> abs(x.p - p) <= 1), x -> transform(sequence(0, x.m - 1), r -> x.p * 16777216L + r)))"
    sent = placed.selectExpr(*names, "g", "t", f"explode(if(tiles IS NULL, array(t), {partners})) AS o").selectExpr("g", "least(t, o) AS ta", "greatest(t, o) AS tb", "t", *names)

    def kernel(key, table):  # no hints: Spark reads them
        _, ta, tb = (k.as_py() for k in key)
        t, names = (table.column(c).to_numpy() for c in ("t", "node"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype="<u8").astype(np.uint64).reshape(-1, WIDE)
        u = v = np.empty(0, np.int64)
        if ta == tb or ((t == ta).any() and (t == tb).any()):
            tiny = int(table.column("n").to_numpy().min() <= TINY)
            order = np.argsort(np.bitwise_count(bits).sum(axis=1, dtype=np.int64), kind="stable")
            a = order[t[order] == ta]
            b = a if ta == tb else order[t[order] == tb]
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("items")]
            check = _alike([sets[i] for i in a.tolist()], [sets[i] for i in b.tolist()])
            labels = names[a] if ta == tb else names[np.concatenate([a, b])]
            p, q = _wide_links(bits[a], bits[b], labels, FIRST[tiny], RADIUS[tiny], ta == tb, check)
            u, v = names[a[p]], names[b[q]]
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return sent.groupBy("g", "ta", "tb").applyInArrow(kernel, "u long, v long")


def near_classes(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the nodes that have near copies; root is the smallest node reachable.

    ``nodes(node, bands)`` holds each set of shingles once; ``sets`` gives (node, n, bits, items)
    of a table of nodes. Shared bands make groups, and only nodes that have a group are compared,
    within it and on their whole sets. No table grows with the square of a bunch: a band gives a
    star, a bin or two tiles a forest.
    """
    spark = nodes.sparkSession
    groups = candidate_groups(nodes)
    some = materialise(sets(groups.select("node")).join(groups.withColumnRenamed("root", "grp"), "node"), "dedup-sets")
    small_batches(spark)
    links = materialise(near_links(some), "dedup-links")
    roots = materialise(connected_components(links, "dedup-cc"), "dedup-roots")
    discard(spark, groups, some, links)
    return roots


def near_dedup(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each near-duplicate class of ``docs``, with all its columns.

    Two texts are linked if their sets of ``words``-word shingles (words by ASCII white space,
    in ASCII lower case) have a Jaccard of NEAR or more; a class is all that links reach.
    Shared bands of minima group the sets, fingerprints compared within groups give the candidates
    (a pair at 0.8 is missed with a chance of about 1e-5, of which the bands have 4e-7), and each
    link is confirmed on the whole sets. Null and empty
    texts (and those of white space) are one class. The row with the smallest doc_id stays
    (numbers first, then other doc_ids as text, null last; ties by the text's hash), and rows
    with that same doc_id and text count as one. An empty table stays empty; columns of any name
    pass through, and an absent one counts as null.
    """
    placed, at = by_place(docs)
    named = F.col(at["doc_id"]) if "doc_id" in at else F.lit(None)
    text = F.col(at["text"]).cast("string") if "text" in at else F.lit(None).cast("string")
    key = F.struct(F.coalesce(named.cast("string").try_cast("bigint"), F.lit((1 << 63) - 1)).alias("i"), F.coalesce(named.cast("string"), F.lit("\U0010ffff")).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    plain = placed.select(key.alias("key"), text.alias("text"))

    def sketch(texts: list[str]) -> dict[str, list]:
        sets = shingles(texts, words)
        return {"node": set_keys(sets), "bands": bands(sets)}

    def whole(texts: list[str]) -> dict[str, list]:
        sets = shingles(texts, words)
        return {"node": set_keys(sets), "n": [len(s) for s in sets], "bits": wide_prints(sets), "items": [s.tobytes() for s in sets]}

    rows = materialise(map_texts(plain, sketch, fields(node="long", bands="longs")), "dedup")
    nodes = materialise(rows.groupBy("node").agg(F.min("key").alias("rep"), F.any_value("bands").alias("bands")), "dedup-nodes")

    def sets_of(some: DataFrame) -> DataFrame:
        reps = nodes.join(some, "node", "left_semi").select(F.col("rep").alias("key"))
        chosen = plain.join(reps, "key", "left_semi").dropDuplicates(["key"])
        return map_texts(chosen, whole, fields(node="long", n="long", bits="binary", items="binary")).drop("key")

    roots = near_classes(nodes.select("node", "bands"), sets_of)
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("rep").alias("rep")).select("rep.i", "rep.d", "rep.h")
    held = placed.withColumns({k: key[k] for k in ("i", "d", "h")})
    one = held.join(kept, ["i", "d", "h"], "left_semi").dropDuplicates(["i", "d", "h"])
    return one.select(*placed.columns).toDF(*docs.columns)
