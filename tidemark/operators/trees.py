"""Boosted trees by the rules of pyspark.ml, without its jobs for each level of each tree.

Values become bins once.  Boosting is one job: its tasks keep their rows, and sum histograms among themselves.  Draws
depend on a row's id and sums are of integers, so a model is the same in every layout of the rows.
"""

from __future__ import annotations

import secrets
import socket
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of at most so many values are cut between any two of them.
BINS = 256
#: Rows of a boosting task, as far as the cluster has cores.
TASK_ROWS = 1_000_000
#: Gradients are multiples of 1 / GRAIN, so sums of 2 ** 27 of them are exact.
GRAIN = float(1 << 24)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of 64 bits (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """A number from 0 to 1 for each id, another one for each salt."""
    at = np.zeros(1, np.uint64)
    for s in salt:
        at = mixed(at ^ np.uint64(s))
    return (mixed(ids.astype(np.uint64) ^ at) >> np.uint64(11)) * 2.0**-53


def cuts(rows: DataFrame, arity: list[int]) -> list[np.ndarray | None]:
    """For each place of the vectors v the values at which it may be cut, or None where it holds a category's index."""
    own = [i for i, n in enumerate(arity) if not n]
    if not own:
        return [None] * len(arity)
    at = {i: F.col("v")[i] for i in own}
    about = rows.agg(*(F.approx_count_distinct(c).alias(f"n_{i}") for i, c in at.items())).first()
    steps = [i / BINS for i in range(1, BINS)]
    # the count is off by some hundredths: near BINS both ways are asked for
    few, many = ({i for i in own if about[f"n_{i}"] <= 1.5 * BINS}, {i for i in own if about[f"n_{i}"] > 0.7 * BINS})
    asked = [F.collect_set(at[i]).alias(f"few_{i}") for i in few] + [F.percentile_approx(at[i], steps, 20_000).alias(f"many_{i}") for i in many]
    found = rows.agg(*asked).first().asDict()
    out: list[np.ndarray | None] = [None] * len(arity)
    for i in own:
        values = np.unique(np.array(found.get(f"few_{i}") or [], float))
        out[i] = (values[1:] + values[:-1]) / 2 if len(values) <= BINS and i in few else np.unique(np.array(found[f"many_{i}"], float))
    return out


def binned(v: pa.Array, edges: list[np.ndarray | None]) -> np.ndarray:
    """Bins by place and row."""
    flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), len(edges))
    return np.stack([(flat[:, i] if e is None else np.searchsorted(e, flat[:, i])).astype(np.uint16) for i, e in enumerate(edges)])


class Peers:
    """The tasks of a barrier stage as a binary tree of sockets over which they add arrays."""

    def __init__(self, token: bytes):
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        hosts = [x.address.rsplit(":", 1)[0].strip("[]") for x in context.getTaskInfos()]
        self.rank, self.up, self.down = context.partitionId(), None, []
        with socket.create_server((hosts[self.rank], 0), family=socket.AF_INET6 if ":" in hosts[self.rank] else socket.AF_INET) as server:
            ports = context.allGather(str(server.getsockname()[1]))
            if self.rank:
                above = (self.rank - 1) // 2
                self.up = socket.create_connection((hosts[above], int(ports[above])))
                self.up.sendall(token + self.rank.to_bytes(4, "big"))
            found = {}
            while len(found) < sum(r < len(hosts) for r in (2 * self.rank + 1, 2 * self.rank + 2)):
                one, _ = server.accept()
                said = self._read(one, len(token) + 4)
                if secrets.compare_digest(said[:-4], token):
                    found[int.from_bytes(said[-4:], "big")] = one
                else:
                    one.close()
            self.down = [found[r] for r in sorted(found)]

    @staticmethod
    def _read(one: socket.socket, n: int) -> bytes:
        out = bytearray(n)
        view, at = memoryview(out), 0
        while at < n:
            got = one.recv_into(view[at:])
            if not got:
                raise ConnectionError("a task of the stage has gone")
            at += got
        return bytes(out)

    def add(self, a: np.ndarray) -> np.ndarray:
        for one in self.down:
            a = a + np.frombuffer(self._read(one, a.nbytes)).reshape(a.shape)
        if self.up:
            self.up.sendall(a.tobytes())
            a = np.frombuffer(self._read(self.up, a.nbytes)).reshape(a.shape)
        for one in self.down:
            one.sendall(a.tobytes())
        return a


@dataclass(frozen=True)
class Boosting:
    trees: int
    rate: float
    depth: int
    least: int
    rows: float
    columns: float
    seed: int


#: Of a node: tree, place (root 1, children of i at 2i and 2i + 1), rows, sum and sum of squares of gradients, gain, feature (-1 in a leaf), last bin on the left or the categories there.
NODE = "tree int, place int, n double, s double, q double, gain double, feature int, bin int, left array<int>"


def _levels(x, g, sizes, arity, how: Boosting, tree: int, add, everyone) -> tuple[list[tuple], np.ndarray]:
    """The nodes of one tree over the drawn rows x and g, and the value of the leaf of each row of `everyone`."""
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    total, nodes, value = starts[-1], [], np.zeros(2 << how.depth)
    at, all_at = np.ones(len(g), np.int64), np.ones(everyone.shape[1], np.int64)
    taken = max(1, int(np.ceil(how.columns * len(sizes))))
    open_ = {1}
    for level in range(how.depth + 1):
        first = k = 1 << level
        last = level == how.depth
        local, sums = at - first, np.zeros((2, k, total + 1))
        for part, weights in ((0, None), (1, g)):
            for f in range(len(sizes)) if not last else ():
                sums[part, :, starts[f] : starts[f + 1]] = np.bincount(local * sizes[f] + x[f], weights, k * sizes[f]).reshape(k, sizes[f])
        totals = np.stack([np.bincount(local, w, k).astype(float) for w in (None, g, np.rint(g * g / GRAIN))])
        both = add(np.concatenate([sums[:, :, :-1].ravel(), totals.ravel()]) if not last else totals.ravel())
        totals = both[-3 * k :].reshape(3, k)
        sums = both[: -3 * k].reshape(2, k, total) if not last else None
        going = set()
        for place in sorted(open_):
            i = place - first
            n, s, q = totals[0, i], totals[1, i] / GRAIN, totals[2, i] / GRAIN
            value[place] = s / n if n else 0.0
            best = (0.0, -1, -1, None)
            if not last and n >= 2 * how.least:
                for f in np.sort(np.argsort(uniform(np.arange(len(sizes)), how.seed, 2, tree, place), kind="stable")[:taken]):
                    c, t = (sums[p, i, starts[f] : starts[f + 1]] for p in (0, 1))
                    order = np.argsort(np.where(c > 0, t / np.maximum(c, 1), np.inf), kind="stable") if arity[f] else None
                    lc, lt = (np.cumsum(a if order is None else a[order])[:-1] for a in (c, t))
                    rc, ok = n - lc, (lc >= how.least) & (n - lc >= how.least)
                    if not ok.any():
                        continue
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(ok, (lt * lt / lc + (totals[1, i] - lt) ** 2 / rc - totals[1, i] ** 2 / n) / GRAIN / GRAIN / n, -1.0)
                    b = int(np.argmax(gain))
                    if gain[b] > max(best[0], 1e-15):
                        best = (float(gain[b]), int(f), b, None if order is None else sorted(int(o) for o in order[: b + 1]))
            nodes.append((tree, place, float(n), float(s), float(q), *best))
            if best[1] < 0:
                continue
            going |= {2 * place, 2 * place + 1}
            f, b, left = best[1:]
            side = np.ones(sizes[f], np.int64)
            side[: b + 1] = 0
            if left is not None:
                side[:] = 1
                side[left] = 0
            for where, bins in ((at, x), (all_at, everyone)):
                here = np.flatnonzero(where == place)
                where[here] = 2 * place + side[bins[f][here]]
        if not going:
            break
        # rows of finished leaves count no more
        keep = np.isin(at, sorted(going))
        x, g, at, open_ = x[:, keep], g[keep], at[keep], going
    return nodes, value[all_at]


def boost(x: np.ndarray, y: np.ndarray, ids: np.ndarray, sizes: list[int], arity: list[int], how: Boosting, add: Callable[[np.ndarray], np.ndarray]) -> Iterator[list[tuple]]:
    """The nodes of each tree.  As pyspark.ml: the first tree learns -1 and 1 and counts whole, each later one 4y / (1 + exp(2yF))."""
    score, sign = np.zeros(len(y)), 2 * y - 1
    for tree in range(how.trees):
        g = np.rint(GRAIN * (sign if not tree else 4 * sign / (1 + np.exp(2 * sign * score))))
        drawn = np.flatnonzero(uniform(ids, how.seed, 1, tree) < how.rows)
        nodes, values = _levels(x[:, drawn], g[drawn], sizes, arity, how, tree, add, x)
        score += values if not tree else how.rate * values
        yield nodes


def boosted_nodes(rows: DataFrame, arity: list[int], how: Boosting, task_rows: int = TASK_ROWS) -> tuple[list[tuple], list[np.ndarray | None]]:
    """The nodes of all trees over rows (id, label, v), and the cuts."""
    edges = cuts(rows, arity)
    sizes = [n or len(e) + 1 for n, e in zip(arity, edges, strict=True)]
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // task_rows)))
    token = secrets.token_bytes(32)
    names = [c.split()[0] for c in NODE.split(", ")]

    def run(batches):
        parts = [(binned(b.column("v"), edges), b.column("label").to_numpy(), b.column("id").to_numpy()) for b in batches if b.num_rows]
        x = np.concatenate([p[0] for p in parts], 1) if parts else np.zeros((len(edges), 0), np.uint16)
        y, ids = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind) for i, kind in ((1, float), (2, np.int64)))
        peers = Peers(token) if tasks > 1 else None
        for nodes in boost(x, y, ids, sizes, arity, how, peers.add if peers else lambda a: a):
            if not peers or not peers.rank:
                columns = list(zip(*nodes, strict=True))
                kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    dealt = rows.select("id", "label", "v").repartition(tasks) if tasks > 1 else rows.select("id", "label", "v").coalesce(1)
    return [tuple(r) for r in dealt.mapInArrow(run, NODE, barrier=tasks > 1).collect()], edges


def gbt_model(spark, nodes: list[tuple], edges: list[np.ndarray | None], arity: list[int], rate: float):
    """The nodes as pyspark.ml's own model, which can be saved, loaded and asked for importances."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.util import Identifiable

    java, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    ml, impurity = java.org.apache.spark.ml, java.org.apache.spark.mllib.tree.impurity

    def doubles(values) -> object:
        """As one array of the JVM."""
        data = np.asarray(values, ">f8")
        out = gateway.new_array(gateway.jvm.double, len(data))
        java.java.nio.ByteBuffer.wrap(bytearray(data.tobytes())).asDoubleBuffer().get(out)
        return out

    stats, calculators = doubles([x for t in nodes for x in (*t[2:5], t[2])]), impurity.VarianceAggregator()
    # a name costs a call to the JVM each time it is looked up
    leaf, inner, by_value, by_category = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit, ml.tree.CategoricalSplit
    regressor = ml.regression.DecisionTreeRegressionModel
    made: dict[tuple[int, int], object] = {}
    for i, (tree, place, n, s, q, gain, feature, b, left) in sorted(enumerate(nodes), key=lambda x: -x[1][1]):
        mean = s / n if n else 0.0
        around = max(0.0, q / n - mean * mean) if n else 0.0
        calculator = calculators.getCalculator(stats, 4 * i)
        if feature < 0:
            made[tree, place] = leaf(mean, around, calculator)
        else:
            split = by_category(feature, doubles(left), arity[feature]) if arity[feature] else by_value(feature, float(edges[feature][b]))
            made[tree, place] = inner(mean, around, gain, made.pop((tree, 2 * place)), made.pop((tree, 2 * place + 1)), split, calculator)
    trees = gateway.new_array(regressor, len(made))
    for tree, _ in made:
        trees[tree] = regressor(f"dtr_{tree}", made[tree, 1], len(edges))
    uid = Identifiable._randomUID.__func__(GBTClassificationModel)
    return GBTClassificationModel(ml.classification.GBTClassificationModel(uid, trees, doubles([1.0] + [rate] * (len(made) - 1)), len(edges), 2))
