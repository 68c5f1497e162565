"""Near-duplicate pairs by range join, and connected components of the resulting graph."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.functions.basics import finite
from surveyframe.operators.scale import cumulative, fits_packed, materialise, salted_join

PERIOD_TOLERANCE = 1e-4   # fixed value: largest relative period difference of twins
EPOCH_FACTOR = 0.5        # fixed value: largest folded epoch offset in durations
BUCKETS_PER_CELL, SIGNALS_PER_TASK = 32, 500_000      # period buckets that are compared in one place; rows of a task, about
EDGES_AT_ONCE = 1 << 21                               # edges that are folded into a forest together


def folded_offset(t1, t2, p):
    """|t2 - t1| folded into [0, p/2]."""
    return F.abs(F.pmod(t2 - t1 + 0.5 * p, p) - 0.5 * p)


def _near_pairs(df: DataFrame, tolerance: float, factor: float, carry: list[str]) -> DataFrame:
    """Pairs (a, b) of rows id, p, t, d with p_b in [p_a, p_a (1 + tolerance)] and a small folded offset.

    Periods are cut into logarithmic buckets slightly wider than the tolerance.  The lower period looks
    into its own and the next bucket, the higher one sits in its own, so each pair meets exactly once.
    """
    ok = _in_buckets(df, tolerance)
    side = lambda s, extra: ok.select(*[F.col(c).alias(f"{s}_{c}") for c in ["id", "p", "t", "d", *carry]], extra)
    low = side("a", F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"))
    high = side("b", F.col("_b"))
    pairs = salted_join(low, high, ["_b"])
    ordered = (F.col("b_p") > F.col("a_p")) | ((F.col("b_p") == F.col("a_p")) & (F.col("b_id") > F.col("a_id")))
    near = folded_offset(F.col("a_t"), F.col("b_t"), F.col("a_p")) < factor * F.greatest("a_d", "b_d")
    return pairs.filter(ordered & (F.col("b_p") <= F.col("a_p") * (1 + tolerance)) & near)


def _in_buckets(df: DataFrame, tolerance: float) -> DataFrame:
    width = math.log1p(tolerance) * (1 + 1e-9)
    return df.filter(finite("p") & finite("t") & finite("d") & (F.col("p") > 0)).withColumn("_b", F.floor(F.ln("p") / width))


def signal_twins(df: DataFrame, row: str, star: str, period: str, epoch: str, duration_days: str,
                 tolerance: float = PERIOD_TOLERANCE, factor: float = EPOCH_FACTOR) -> DataFrame:
    """(a_id, b_id, a_star, b_star): candidates on different stars that share one signal."""
    src = df.select(F.col(row).alias("id"), F.col(star).alias("star"), F.col(period).cast("double").alias("p"),
                    F.col(epoch).cast("double").alias("t"), F.col(duration_days).cast("double").alias("d"))
    pairs = _near_pairs(src, tolerance, factor, ["star"])
    return pairs.filter("a_star <> b_star").select("a_id", "b_id", "a_star", "b_star")


def components(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """node -> root (smallest node of its component).

    Whole numbers: every task first folds its edges into a forest; where a task can hold the numbers of all nodes, the
    forests are joined there, and otherwise by alternating large-star and small-star steps, as for other nodes.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    if pairs.schema["u"].dataType.typeName() in ("integer", "long"):
        labels = _labels(_forests(pairs), nodes.agg(F.approx_count_distinct(node)).first()[0])
    else:
        labels = _star_labels(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), False)
    every = nodes.select(node).distinct()
    return every.join(labels.withColumnRenamed("u", node), node, "left").select(node, F.coalesce("root", node).alias("root"))


def _labels(forests: DataFrame, nodes: int) -> DataFrame:
    """(u, root) for the nodes that hang on a smaller one, from packed forests over about so many nodes."""
    if fits_packed(forests, nodes):
        return _rooted(forests)
    return _star_labels(_unpacked(forests).filter("u <> v").distinct(), True)


def _star_labels(edges: DataFrame, numbers: bool) -> DataFrame:
    """(u, root) from edges (u, v) with u > v.

    A node's smallest neighbour is a combinable aggregate and the join back is salted, so a node with very
    many neighbours is never gathered.  Each round is written to the checkpoint folder; rounds go on until
    the edges no longer change, their number grows with the logarithm of the longest chain.  Every round leaves fewer
    edges; once a task can hold their numbers, the rest is done there.
    """
    live, seen = materialise(edges), None
    while True:
        mark = live.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        if numbers and fits_packed(live, mark[0]):
            return _rooted(_forests(live))
        seen = mark
        live = materialise(_star_step(_star_step(live, large=True), large=False))
    return live.groupBy("u").agg(F.min("v").alias("root"))


def smallest_of_component(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a-b and the smallest node of each one's component: roots hang on smaller ones until none is left to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


class _Forest:
    """Edges of a task, folded into one edge from each node to the smallest one of its component as they come."""

    def __init__(self):
        self.a = self.b = np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = a != b
        if apart.any():
            self.more.append((a[apart], b[apart]))
            self.size += len(self.more[-1][0])
            if self.size > max(EDGES_AT_ONCE, len(self.a)):
                self.fold()

    def fold(self) -> None:
        node, root = smallest_of_component(*(np.concatenate([own, *[m[i] for m in self.more]]) for i, own in enumerate((self.a, self.b))))
        self.a, self.b = node[node != root], root[node != root]
        self.more, self.size = [], 0

    def packed(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        for lo in range(0, len(self.a), EDGES_AT_ONCE // 8):
            yield pa.RecordBatch.from_pydict({n: pa.array([x[lo:lo + EDGES_AT_ONCE // 8].astype(np.int64).tobytes()], pa.binary()) for n, x in (("u", self.a), ("v", self.b))})


def _numbers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for u, v in zip(batch.column("u"), batch.column("v")):
        yield np.frombuffer(u.as_py(), np.int64), np.frombuffer(v.as_py(), np.int64)


PACKED_EDGES = "u binary, v binary"


def _forests(edges: DataFrame) -> DataFrame:
    """The edges (u, v) of every task as a packed forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for x in batches:
            forest.add(x.column("u").to_numpy(), x.column("v").to_numpy())
        yield from forest.packed()

    return edges.dropna().select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).mapInArrow(run, PACKED_EDGES)


def _unpacked(forests: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for u, v in _numbers(x):
                yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    return forests.mapInArrow(run, "u bigint, v bigint")


def _rooted(forests: DataFrame) -> DataFrame:
    """(u, root) for every node that hangs on a smaller one, from packed forests whose nodes a task can hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for x in batches:
            for u, v in _numbers(x):
                forest.add(u, v)
        forest.fold()
        for lo in range(0, len(forest.a), 100_000):
            yield pa.RecordBatch.from_pydict({"u": forest.a[lo:lo + 100_000], "root": forest.b[lo:lo + 100_000]})

    return materialise(forests.repartition(1).mapInArrow(run, "u bigint, root bigint"))


def _star_step(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: hang bigger neighbours on the smallest neighbour.  Small star: hang smaller ones on it."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    j = salted_join(both, smallest, ["u"])
    if large:
        out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def numbered(components_df: DataFrame, name: str = "family") -> DataFrame:
    """Add a dense number per root, in the order of the roots."""
    roots = cumulative(components_df.select("root").distinct(), "root", {name: F.lit(1).cast("bigint")})
    return salted_join(components_df, roots, ["root"])


class _Signals:
    """Signals of a task: rows with equal period, epoch and positive duration are one, which links their stars to its smallest."""
    COLUMNS = ("p", "t", "d", "id", "node")

    def __init__(self, forest: _Forest):
        self.forest, self.kept, self.more, self.size = forest, None, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.more.append([batch.column(c).to_numpy() for c in self.COLUMNS])
        self.size += batch.num_rows
        if self.size > max(EDGES_AT_ONCE, len(self.kept[0]) if self.kept else 0):
            self.fold()

    def fold(self) -> None:
        p, t, d, row, node = (np.concatenate(x) for x in zip(*([self.kept] if self.kept else []), *self.more))
        order = np.lexsort((node, d, t, p))
        p, t, d, row, node = (x[order] for x in (p, t, d, row, node))
        same = (p[1:] == p[:-1]) & (t[1:] == t[:-1]) & (d[1:] == d[:-1]) & ((d[1:] > 0) | (node[1:] == node[:-1]))
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        self.forest.add(node, np.repeat(node[first], np.diff(first, append=len(p))))
        self.kept, self.more, self.size = [p[first], t[first], d[first], np.minimum.reduceat(row, first), node[first]], [], 0

    def link_twins(self, tolerance: float, factor: float) -> None:
        """Compare every signal with the ones up to the tolerance above its period, a step further at a time."""
        if self.more:
            self.fold()
        if self.kept is None:
            return
        p, t, d, row, node = self.kept
        reach = np.searchsorted(p, p * (1 + tolerance), "right") - np.arange(len(p))
        slack = 1e-9 * (1 + np.abs(t).max() + p.max())                  # the turns are counted roughly first
        i, k = np.flatnonzero(reach > 1), 1
        while len(i):
            j = i + k
            turns = (t[j] - t[i]) / p[i]
            turns -= np.rint(turns)
            np.abs(turns, out=turns)
            turns *= p[i]
            near = np.flatnonzero((turns < factor * np.maximum(d[i], d[j]) + slack) & (node[i] != node[j]))
            a, b = i[near], j[near]
            turned = (p[a] == p[b]) & (row[b] < row[a])
            a, b = np.where(turned, b, a), np.where(turned, a, b)
            near = np.abs(np.mod(t[b] - t[a] + 0.5 * p[a], p[a]) - 0.5 * p[a]) < factor * np.maximum(d[a], d[b])
            self.forest.add(node[a[near]], node[b[near]])
            k += 1
            i = i[reach[i] > k]


def _star_links(rows: DataFrame, size: int, tolerance: float, factor: float) -> DataFrame:
    """Packed forests over the nodes of so many rows (id, node, p, t, d) whose signals are twins.

    A cell of neighbouring period buckets meets in one task, together with the first bucket of the next cell.
    """
    b = F.col("_b")
    cell = F.floor(b / BUCKETS_PER_CELL)
    placed = _in_buckets(rows, tolerance).withColumn("_cell", F.explode(F.when(b % BUCKETS_PER_CELL == 0, F.array(cell, cell - 1)).otherwise(F.array(cell))))
    tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // SIGNALS_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        signals = _Signals(forest)
        for x in batches:
            signals.add(x)
        signals.link_twins(tolerance, factor)
        yield from forest.packed()

    return placed.select(*_Signals.COLUMNS, "_cell").repartition(tasks, "_cell").mapInArrow(run, PACKED_EDGES)


def star_families(df: DataFrame, row: str, star: str, period: str, epoch: str, duration_days: str) -> DataFrame:
    """(star, root): components of {same star} and {signal twin} as stars with the smallest row of their component.

    Only stars are nodes.  Rows with equal period, epoch and positive duration are twins of each other, so exact copies
    collapse to one signal and tie their stars; only distinct signals are compared.  Copies without a duration are no twins
    of each other and stay apart.  Whether two linked signals share a star does not matter, since the star links them anyway.
    """
    src = df.select(F.col(row).alias("id"), F.col(star).alias("star"), F.col(period).cast("double").alias("p"),
                    F.col(epoch).cast("double").alias("t"), F.col(duration_days).cast("double").alias("d")).filter(F.col("star").isNotNull())
    whole = lambda c: src.schema[c].dataType.typeName() in ("integer", "long")
    stars = src.groupBy("star").agg(F.min("id").alias("first"))
    if whole("star"):
        stars, rows = stars.withColumn("node", F.col("star").cast("bigint")), src.withColumn("node", F.col("star").cast("bigint"))
    else:
        stars = materialise(stars.withColumn("node", F.monotonically_increasing_id()))
        rows = salted_join(src, stars.select("star", "node"), ["star"])
    rows = rows.select("p", "t", "d", "node", F.coalesce(F.col("id").cast("bigint"), F.lit(0)).alias("id") if whole("id") else F.col("node").alias("id"))
    size, nodes = rows.agg(F.count("*"), F.approx_count_distinct("node")).first()
    labels = _labels(_star_links(rows, size, PERIOD_TOLERANCE, EPOCH_FACTOR), nodes)
    placed = materialise(stars.join(labels.withColumnRenamed("u", "node"), "node", "left").select("star", "first", F.coalesce("root", "node").alias("family")))
    roots = placed.groupBy("family").agg(F.min("first").alias("root"))
    return materialise(salted_join(placed, roots, ["family"]).select("star", "root"))


def signal_families(df: DataFrame, row: str, star: str, period: str, epoch: str, duration_days: str, carry: Sequence[str] = ()) -> DataFrame:
    """(row, carried columns, family_root): components of {same star} and {signal twin}, named by their smallest row."""
    found = star_families(df, row, star, period, epoch, duration_days).select(F.col("star").alias(star), F.col("root").alias("family_root"))
    return salted_join(df.select(*dict.fromkeys([row, star, *carry])), found, [star]).select(row, *carry, "family_root")


def overlapping_sets(df: DataFrame, set_id: str, member: str) -> DataFrame:
    """Group sets that share members, with full transitive closure: (set_id, group) with group the smallest set."""
    pairs = df.select(set_id, member).distinct()
    first = pairs.groupBy(member).agg(F.min(set_id).alias("a"))
    edges = salted_join(pairs, first, [member]).select("a", F.col(set_id).alias("b"))
    found = components(edges, pairs.select(F.col(set_id).alias("node")))
    return found.select(F.col("node").alias(set_id), F.col("root").alias("group"))
