"""Forests by the rules of pyspark.ml, whose nodes of few rows cost no histograms of all bins.

Nodes of very many rows are split by all tasks, which sum up what they hold.  Below these, a task gets the rows that a
tree drew for a node, and grows the rest.  The trees stay a table: neither they nor the rows come to the driver.
Draws depend on a row's id and sums are of integers, so a forest is the same in every layout of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.trees import binned, cuts, uniform

#: A forest's answer is a sum of multiples of 1 / UNIT.
UNIT = float(1 << 40)
#: Shares of a forest that score rows side by side, and rows that meet a share at once.
SHARES, SHARE_ROWS = 24, 1_000_000


@dataclass(frozen=True)
class Growing:
    """taken: features that a node may choose from; big: rows from which a node is split by all tasks."""

    trees: int
    depth: int
    least: int
    taken: int
    seed: int
    big: int = 2_000_000


POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 20)]))
PART = "tree int, place int, places binary, feature binary, bin binary, p binary"


def drawn(ids: np.ndarray, copies: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: a Poisson number of mean 1 for each of its copies."""
    out = np.zeros(len(ids), np.int64)
    for j in range(int(copies.max(initial=0))):
        some = np.flatnonzero(copies > j)
        out[some] += np.searchsorted(POISSON, uniform(ids[some], seed, 3, tree, j), side="right")
    return out


def _summed(key: np.ndarray, w: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order, each once, with its sums."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else np.zeros(0, int)
    total = lambda a: np.diff(np.cumsum(a[order])[ends], prepend=0)
    return key[ends], total(w), total(wy)


def _slots(places: np.ndarray, n_features: int, tree: int, how: Growing) -> np.ndarray:
    """The features that each node may choose from, in order."""
    one = (places.astype(np.uint64)[:, None] << np.uint64(16)) | np.arange(n_features, dtype=np.uint64)
    return np.sort(np.argsort(uniform(one, how.seed, 4, tree), axis=1, kind="stable")[:, : how.taken], axis=1)


def _entries(x: np.ndarray, at: np.ndarray, w: np.ndarray, wy: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by node, its slot and bin; a key holds the three in 32, 16 and 16 bits."""
    taken, rows, width = slots.shape[1], np.arange(x.shape[1]), int(x.max(initial=0)) + 1
    keys = np.concatenate([((at * taken + s) * width) + x[slots[at, s], rows] for s in range(taken)])
    w, wy, cells = np.tile(w, taken), np.tile(wy, taken), len(slots) * taken * width
    if cells <= 4 * len(keys):
        sums = [np.bincount(keys, a, cells) for a in (w, wy)]
        key = np.flatnonzero(sums[0])
        sums = [a[key].astype(np.int64) for a in sums]
    elif cells < 1 << 33 and w.max(initial=0) < 1 << 15:
        both = np.sort((keys << 30) | (w << 15) | wy)
        key = both >> 30
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else np.zeros(0, int)
        sums = [np.diff(np.cumsum(a)[ends], prepend=0) for a in ((both >> 15) & 0x7FFF, both & 0x7FFF)]
        key = key[ends]
    else:
        key, *sums = _summed(keys, w, wy)
    node, rest = np.divmod(key, taken * width)
    slot, bins = np.divmod(rest, width)
    return (node << 32) | (slot << 16) | bins, *sums


def _chosen(k: int, entries: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """For each of k nodes rows, leavers, slot (-1: a leaf), bin, and rows on the left: the largest gain of Gini impurity."""
    key, w, wy = entries
    n, pos, left = np.zeros(k), np.zeros(k), np.zeros(k, np.int64)
    slot, bins = np.full(k, -1), np.full(k, -1)
    if not len(key):
        return n, pos, slot, bins, left
    node, group = key >> 32, key >> 16
    firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    lengths = np.diff(np.append(firsts, len(key)))
    lw, lp = (np.cumsum(a) - np.repeat((np.cumsum(a) - a)[firsts], lengths) for a in (w, wy))
    ends = firsts + lengths - 1
    n[node[ends]], pos[node[ends]] = lw[ends], lp[ends]
    total, leavers = n[node], pos[node]
    rw, rp = total - lw, leavers - lp
    ok = (lw >= least) & (rw >= max(1, least))
    with np.errstate(divide="ignore", invalid="ignore"):
        squares = lambda p, m: (p * p + (m - p) * (m - p)) / m
        gain = np.where(ok, (squares(lp, lw) + squares(rp, rw) - squares(leavers, total)) / total, -1.0)
    nodes = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    best = np.maximum.reduceat(gain, nodes)
    i = np.flatnonzero(gain == np.repeat(best, np.diff(np.append(nodes, len(key)))))
    i = i[np.append(True, node[i][1:] != node[i][:-1])]
    i = i[gain[i] > 1e-15]
    slot[node[i]], bins[node[i]], left[node[i]] = (key[i] >> 16) & 0xFFFF, key[i] & 0xFFFF, lw[i]
    return n, pos, slot, bins, left


def grow(x: np.ndarray, w: np.ndarray, y: np.ndarray, tree: int, place: int, how: Growing) -> tuple[np.ndarray, ...]:
    """Place, feature, last bin on the left and share of leavers of each node from one place of a tree on."""
    places, at, wy, out = np.array([place]), np.zeros(len(w), np.int64), w * y, []
    while len(places):
        deep = int(places[0]).bit_length() > how.depth
        if deep:
            n, pos = (np.bincount(at, a, len(places)) for a in (w, wy))
            feature = bins = np.full(len(places), -1)
        else:
            slots = _slots(places, len(x), tree, how)
            n, pos, slot, bins, _ = _chosen(len(places), _entries(x, at, w, wy, slots), how.least)
            feature = np.where(slot < 0, -1, slots[np.arange(len(places)), slot])
        out.append((places, feature, bins, pos / np.maximum(n, 1)))
        on = np.flatnonzero(feature >= 0)
        index = np.full(len(places), -1)
        index[on] = np.arange(len(on))
        rows = np.flatnonzero(index[at] >= 0)
        at = at[rows]
        side = x[feature[at], rows] > bins[at] if len(rows) else np.zeros(0, bool)
        x, w, wy, at = x[:, rows], w[rows], wy[rows], 2 * index[at] + side
        places = np.stack([2 * places[on], 2 * places[on] + 1], 1).ravel()
    return tuple(np.concatenate(a) for a in zip(*out, strict=True))


def _routed(x: np.ndarray, feature: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The place of each row in a tree whose nodes stand at their places; -1 has no children."""
    place, rows = np.ones(x.shape[1], np.int64), np.arange(x.shape[1])
    while len(rows):
        f = feature[place[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        place[rows] = 2 * place[rows] + (x[f, rows] > bins[place[rows]])
    return place


def _dense(nodes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature and bin by place of the nodes that are split."""
    size = 2 * max([1, *nodes]) + 2
    feature, bins = np.full(size, -1), np.full(size, -1)
    for place, (f, b) in nodes.items():
        feature[place], bins[place] = f, b
    return feature, bins


def _chunks(batches, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Packed rows by up to 200,000."""
    for b in batches:
        for i in range(0, b.num_rows, 200_000):
            some = b.slice(i, 200_000)
            if some.num_rows:
                x = np.frombuffer(b"".join(some.column("x").to_pylist()), np.uint16).reshape(-1, n).T
                yield np.ascontiguousarray(x), *(some.column(c).to_numpy().astype(np.int64) for c in ("y", "id", "copies"))


def with_bins(df: DataFrame, edges: list[np.ndarray | None]) -> DataFrame:
    """df with x, the bins of its vectors v, in place of v."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def x(v: pa.Array) -> pa.Array:
        return pa.array([r.tobytes() for r in np.ascontiguousarray(binned(v, edges).T)], pa.binary())

    return df.withColumn("x", x("v")).drop("v")


def forest_parts(rows: DataFrame, how: Growing) -> tuple[DataFrame, list[np.ndarray | None]]:
    """The nodes of all trees over rows (id, label, v), in parts that start at a place of a tree, and the cuts."""
    width = len(rows.select("v").first()[0])
    edges, spark = cuts(rows, [0] * width), rows.sparkSession
    packed = with_bins(rows.select("id", F.col("label").cast("int").alias("y"), "v"), edges).groupBy("id", "y", "x").agg(F.count("*").alias("copies")).persist()
    tasks = 4 * spark.sparkContext.defaultParallelism
    top: list[dict[int, tuple[int, int]]] = [{} for _ in range(how.trees)]
    leaves: list[set[int]] = [set() for _ in range(how.trees)]
    shares: dict[tuple[int, int], float] = {}
    n = packed.agg(F.sum("copies")).first()[0] or 0
    waiting = [[1] if n > how.big else [] for _ in range(how.trees)]
    while any(waiting):
        # the functions below run before these change
        asked, trees = [np.array(a) for a in waiting], [_dense(t) for t in top]

        def sums(batches):
            for x, y, ids, copies in _chunks(batches, width):
                for tree, places in enumerate(asked):
                    if len(places):
                        w, place = drawn(ids, copies, tree, how.seed), _routed(x, *trees[tree])
                        at = np.minimum(np.searchsorted(places, place), len(places) - 1)
                        here = np.flatnonzero((places[at] == place) & (w > 0))
                        found = _entries(x[:, here], at[here], w[here], (w * y)[here], _slots(places, width, tree, how))
                        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *(pa.array([a.astype(np.int64).tobytes()], pa.binary()) for a in found)], ["tree", "key", "w", "wy"])

        def choose(key, table):
            tree = key[0].as_py()
            entries = _summed(*(np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("key", "w", "wy")))
            m, pos, slot, bins, left = _chosen(len(asked[tree]), entries, how.least)
            feature = np.where(slot < 0, -1, _slots(asked[tree], width, tree, how)[np.arange(len(slot)), slot])
            return pa.table({"tree": pa.array([tree] * len(m), pa.int32()), "place": pa.array(asked[tree], pa.int32()), "n": m, "left": left.astype(float), "p": pos / np.maximum(m, 1), "feature": pa.array(feature, pa.int32()), "bin": pa.array(bins, pa.int32())})

        level = packed.mapInArrow(sums, "tree int, key binary, w binary, wy binary").repartition(tasks, "tree").groupBy("tree").applyInArrow(choose, "tree int, place int, n double, left double, p double, feature int, bin int").collect()
        waiting = [[] for _ in range(how.trees)]
        for r in sorted(level):
            shares[r.tree, r.place] = r.p
            if r.feature < 0:
                leaves[r.tree].add(r.place)
                continue
            top[r.tree][r.place] = (r.feature, r.bin)
            if r.place.bit_length() < how.depth:
                waiting[r.tree] += [c for c, m in ((2 * r.place, r.left), (2 * r.place + 1, r.n - r.left)) if m > how.big]
    trees = [_dense(t) for t in top]

    def deal(batches):
        for x, y, ids, copies in _chunks(batches, width):
            for tree in range(how.trees):
                w, place = drawn(ids, copies, tree, how.seed), _routed(x, *trees[tree])
                got = np.flatnonzero(w > 0)
                for p in np.unique(place[got]):
                    if p not in leaves[tree]:
                        here = got[place[got] == p]
                        parts = x[:, here].T.tobytes(), (2 * w[here] + y[here]).astype(np.int32).tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([p], pa.int32()), *(pa.array([a], pa.binary()) for a in parts)], ["tree", "place", "x", "wy"])

    def packed_nodes(tree, place, places, feature, bins, p):
        columns = [a.astype(kind).tobytes() for a, kind in ((places, np.int32), (feature, np.int16), (bins, np.int32), (p, float))]
        return [tree, place, *columns]

    def one(key, table):
        tree, place = key[0].as_py(), key[1].as_py()
        x = np.ascontiguousarray(np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint16).reshape(-1, width).T)
        wy = np.frombuffer(b"".join(table.column("wy").to_pylist()), np.int32).astype(np.int64)
        row = packed_nodes(tree, place, *grow(x, wy >> 1, wy & 1, tree, place, how))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in PART.split(", ")])

    parts = packed.mapInArrow(deal, "tree int, place int, x binary, wy binary").repartition(tasks, "tree", "place").groupBy("tree", "place").applyInArrow(one, PART)
    above = []
    for tree in range(how.trees):
        if top[tree] or leaves[tree]:
            places = np.array(sorted({*top[tree], *leaves[tree]}))
            f, b = np.array([top[tree].get(int(p), (-1, -1)) for p in places]).T
            above.append([tree, 0, *map(bytearray, packed_nodes(tree, 0, places, f, b, np.array([shares[tree, int(p)] for p in places]))[2:])])
    return (parts.unionByName(spark.createDataFrame(above, PART)) if above else parts), edges


def whole_tree(parts: Iterator[dict], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, bin and share of leavers by place.  As in pyspark.ml, two leaves of one class become one."""
    size = 2 << depth
    feature, bins, p = np.full(size, -1), np.full(size, -1), np.zeros(size)
    there = np.zeros(size, bool)
    for r in parts:
        at = np.frombuffer(r["places"], np.int32)
        feature[at], bins[at], p[at], there[at] = np.frombuffer(r["feature"], np.int16), np.frombuffer(r["bin"], np.int32), np.frombuffer(r["p"], float), True
    for level in range(depth - 1, -1, -1):
        at = np.arange(1 << level, 2 << level)
        at = at[feature[at] >= 0]
        same = (feature[2 * at] < 0) & (feature[2 * at + 1] < 0) & ((p[2 * at] > 0.5) == (p[2 * at + 1] > 0.5))
        feature[at[same]] = -1
    return feature, bins, p


def forest_shares(df: DataFrame, parts: DataFrame, how: Growing, width: int) -> DataFrame:
    """(x, p): the mean over all trees of the share of leavers in the leaf of each different x of df."""
    asked = df.select("x").distinct().persist()
    spread = max(1, -(-asked.count() // SHARE_ROWS))
    shares = min(SHARES, how.trees)
    left = asked.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(spread)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = parts.withColumn("share", F.pmod("tree", F.lit(shares))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))

    def score(rows, trees):
        raw = rows.column("x").combine_chunks()
        x = np.ascontiguousarray(np.frombuffer(b"".join(raw.to_pylist()), np.uint16).reshape(-1, width).T)
        found: dict[int, list[dict]] = {}
        for r in trees.select(["tree", "places", "feature", "bin", "p"]).to_pylist():
            found.setdefault(r["tree"], []).append(r)
        total = np.zeros(x.shape[1], np.int64)
        for tree in found:
            feature, bins, p = whole_tree(found[tree], how.depth)
            total += np.rint(UNIT * p[_routed(x, feature, bins)]).astype(np.int64)
        return pa.table({"x": raw, "total": total})

    n = min(shares * spread, 4 * df.sparkSession.sparkContext.defaultParallelism)
    keyed = [a.repartition(n, "part", "share").groupBy("part", "share") for a in (left, right)]
    scored = keyed[0].cogroup(keyed[1]).applyInArrow(score, "x binary, total long")
    return scored.groupBy("x").agg((F.sum("total") / (UNIT * how.trees)).alias("p"))
