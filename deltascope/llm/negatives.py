"""Hard negatives: for each anchor and positive the best rows of other labels in a window of scores.

All rows are indexed in a multiway hyperplane tree (``gnat``) whose split points come
from a bounded sample; the ranges of distances are taken over all rows. Rows with the
same vector and label are one class, which keeps its least ids, as many as a result can
show. Leaves are stored in blocks of a bounded number of classes. Queries go, in blocks
too, to the leaves that their annulus reaches, and meet all classes there as integers;
so every result is exact, and no group of equal vectors or large leaf meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.llm.common import named
from deltascope.llm.gnat import Tree, raised
from deltascope.llm.vectors import all_finite, matrix
from deltascope.session import cut_lineage

#: Classes by whose vectors the tree is made, and which give the first bounds of a search.
SAMPLE = 8192
FANOUT = 8
MAX_DEPTH = 4
#: Classes of a leaf that the depth of the tree aims at, and that a block holds at most on average.
LEAF_ROWS = 1024
#: Queries that travel together.
QUERY_ROWS = 256
#: Stands for a NULL id, which comes after all others.
NO_ID = 2**63 - 1
LEAST = -2**62
#: Products under this are exact in doubles.
EXACT = 2**52


def products(x: np.ndarray, y: np.ndarray, top: int) -> np.ndarray:
    """Exact inner products of all rows of x with all rows of y, of squared norms up to ``top``."""
    if top < EXACT:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def first_of(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest scores, equal ones by the smaller id."""
    if len(scores) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))[:n]


class Miner:
    """What all tasks need to know: the tree, the sample, and the bounds of a query."""

    def __init__(self, tree: Tree, dim: int, sample: np.ndarray, labels: np.ndarray):
        self.tree, self.dim, self.sample, self.labels = tree, dim, sample, labels

    def bounded(self, v: np.ndarray, labels: np.ndarray, who: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, same: bool) -> np.ndarray:
        """Lower ends of the windows, raised to the n-th best score that the sample has inside."""
        low = low.copy()
        scores = products(v, self.sample, self.tree.top)
        for e, q in enumerate(who):
            s = scores[q][(self.labels == labels[q]) == same]
            s = s[(s >= low[e]) & (s <= high[e])]
            if len(s) >= n:
                low[e] = max(low[e], np.partition(s, len(s) - n)[len(s) - n])
        return low

    def leaves(self, v: np.ndarray, who: np.ndarray, low: np.ndarray, high: np.ndarray, part: str) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, windows) for the windows' own leaf, or for all others that they reach."""
        flat = np.column_stack([v.astype(np.float64), np.zeros(len(v))])
        own = self.tree.leaf_of(flat)[who]
        if part == "own":
            yield from ((int(leaf), np.flatnonzero(own == leaf)) for leaf in np.unique(own))
            return
        norm = np.einsum("ij,ij->i", flat, flat)[who]
        outer = np.sqrt(np.maximum(norm + self.tree.top - 2.0 * low, 0))
        inner = np.sqrt(np.maximum(norm + self.tree.top - 2.0 * np.minimum(high, 2**61), 0))
        slack = 1e-6 * (np.sqrt(norm) + math.sqrt(self.tree.top) + 1)
        for leaf, entries in self.tree.reached(flat[who], inner, outer, slack):
            entries = entries[own[entries] != leaf] if part == "rest" else entries
            if len(entries):
                yield leaf, entries


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    return df.mapInArrow(run, schema)


def _column(values, kind=None) -> pa.Array:
    return pa.array(values, kind)


def _tree_of(classes: DataFrame, top: int, dim: int, n: int) -> Miner:
    depth = next((d for d in range(MAX_DEPTH) if FANOUT**d * LEAF_ROWS >= n), MAX_DEPTH)
    sample = classes.orderBy("k1", "k2").limit(SAMPLE).select("v", "label").collect()
    points = np.array([r["v"] for r in sample], dtype=np.int32).reshape(-1, dim)
    tree = Tree.grow(points, top, FANOUT, depth)
    miner = Miner(tree, dim, points, np.array([r["label"] for r in sample], dtype=np.int64))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(tree.spans(raised(matrix(batch.column(0), dim), top)))
            yield pa.RecordBatch.from_arrays(
                [_column([f[i] for f in found], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))],
                names=["node", "i", "j", "least", "most"])

    wide = _mapped(classes.select("v"), spans, "node int, i int, j int, least double, most double")
    for row in wide.groupBy("node", "i", "j").agg(F.min("least"), F.max("most")).collect():
        tree.note(*row)
    return miner


def _blocks_of(classes: DataFrame, miner: Miner) -> DataFrame:
    """All classes by leaf, in blocks."""
    tree, dim = miner.tree, miner.dim

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(raised(matrix(batch.column(2), dim), tree.top))
            yield pa.RecordBatch.from_arrays([_column(leaf, pa.int32()), *batch.columns], names=["leaf", *batch.schema.names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cols = [t.column(i).chunk(0) for i in range(5)]
            return pa.RecordBatch.from_arrays(
                [_column([last[0]], pa.int32()), pa.array([cols[2].flatten()], pa.list_(pa.int32())), pa.array([cols[3]], pa.list_(pa.int64())),
                 pa.array([cols[4].flatten()], pa.list_(pa.int64())), pa.array([np.diff(cols[4].offsets.to_numpy())], pa.list_(pa.int32()))],
                names=["leaf", "v", "label", "ids", "n_ids"])

        for batch in batches:
            leaf, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                here = (int(leaf[a]), int(part[a])) if b > a else last
                if held and here != last:
                    yield block()
                    held = []
                last = here
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield block()

    placed = cut_lineage(_mapped(classes.select("k1", "k2", "v", "label", "ids"), place, "leaf int, k1 long, k2 long, v array<int>, label long, ids array<long>"))
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_ROWS).alias("parts"))
    # one row for each leaf, of which there are FANOUT^MAX_DEPTH at most
    dealt = placed.join(F.broadcast(sizes), "leaf").select(
        "leaf", F.pmod(F.xxhash64("k1", "k2"), F.col("parts")).cast("int").alias("part"), "v", "label", "ids")
    packed = dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part")
    return cut_lineage(_mapped(packed, pack, "leaf int, v array<int>, label array<long>, ids array<long>, n_ids array<int>"))


def _search(asked: DataFrame, blocks: DataFrame, miner: Miner, n: int, same: bool, part: str) -> DataFrame:
    """The n best rows of each window (k1, k2, slot), out of the leaves of ``part``.

    ``asked``: k1, k2, v, label, and the lists slot, low, high of the windows.
    """
    tree, dim = miner.tree, miner.dim
    fields = "v array<int>, label array<long>, k1 array<long>, k2 array<long>, who array<int>, slot array<long>, low array<long>, high array<long>"
    names = ["leaf", "q_v", "q_label", "k1", "k2", "who", "slot", "low", "high"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(at, QUERY_ROWS)
                v = matrix(batch.column(2), dim)
                k1, k2, label = (batch.column(i).to_numpy() for i in (0, 1, 3))
                who = np.repeat(np.arange(len(v)), np.diff(batch.column(4).offsets.to_numpy()))
                slot, low, high = (batch.column(i).flatten().to_numpy() for i in (4, 5, 6))
                if not len(who):
                    continue
                low = miner.bounded(v, label, who, low, high, n, same)
                for leaf, entries in miner.leaves(v, who, low, high, part):
                    used, place = np.unique(who[entries], return_inverse=True)
                    columns = [v[used].ravel(), label[used], k1[used], k2[used], place, slot[entries], low[entries], high[entries]]
                    kinds = [pa.int32(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 3]
                    yield pa.RecordBatch.from_arrays(
                        [_column([leaf], pa.int32()), *(pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds))], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_v, q_label, k1, k2, who, slot, low, high, v, label, ids, n_ids = (
                    batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(12))
                q_v, v = q_v.reshape(-1, dim), v.reshape(-1, dim)
                ends = np.cumsum(n_ids)
                first = ids[ends - n_ids]
                scores = products(q_v, v, tree.top)
                norms = np.einsum("ij,ij->i", v.astype(np.int64), v.astype(np.int64))
                own_norm = np.einsum("ij,ij->i", q_v.astype(np.int64), q_v.astype(np.int64))
                out: list[tuple] = []
                for e, q in enumerate(who):
                    s = scores[q]
                    fit = np.flatnonzero((s >= low[e]) & (s <= high[e]) & ((label == q_label[q]) == same))
                    if not len(fit):
                        continue
                    best = fit[first_of(s[fit], first[fit], n)]
                    rows = [(-int(s[b]), int(x), bool(same and s[b] == norms[b] == own_norm[q])) for b in best for x in ids[ends[b] - n_ids[b]:ends[b]]]
                    out += [(int(k1[q]), int(k2[q]), int(slot[e]), -a, x, own) for a, x, own in sorted(rows)[:n]]
                kinds = [pa.int64()] * 5 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([_column([o[c] for o in out], k) for c, k in enumerate(kinds)],
                                                 names=["k1", "k2", "slot", "score", "id", "own"])

    queries = _mapped(asked.select("k1", "k2", "v", "label", "slot", "low", "high"), route,
                      "leaf int, " + fields.replace("v array", "q_v array", 1).replace("label array", "q_label array", 1))
    pairs = queries.join(blocks, "leaf").drop("leaf")
    found = _mapped(pairs, meet, "k1 long, k2 long, slot long, score long, id long, own boolean")
    return _best(found, n)


def _best(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("k1", "k2", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def _listed(best: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key in one list, at most as many as were asked for."""
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "score", "id", "own"))).alias("rows"))


def mine(df: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95,
         id_column: str = "vec_id", label_column: str = "label", vector_column: str = "vector") -> DataFrame:
    """Hard negatives of all rows that ``anchors`` is true for.

    ``vector_column`` is an ``array<int>``, ids and labels are integers. A row's score is
    its inner product with the anchor; greater scores come first, equal ones by the smaller
    id. An anchor's positives are its first ``n_positives`` other rows of the same label.
    For each, the first ``n_negatives`` rows of other labels are returned of which
    ``least * positive <= 100 * negative <= most * positive``, so none if the positive score
    is under 0.

    Rows with a NULL label, vector or component are left out. A vector that is shorter than
    the longest one counts as ending in zeros. A NULL id comes last and is returned as NULL,
    and so is the largest long. Rows with equal ids are rows of their own, and an anchor is
    not its own positive. An empty table, or one label only, gives no rows. Other columns
    are left out, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(named(id_column).cast("long"), F.lit(NO_ID)).alias("id"), named(label_column).cast("long").alias("label"),
                     named(vector_column).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = cut_lineage(rows.filter(F.col("label").isNotNull() & all_finite(F.col("v"))))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    dim, top, n = rows.agg(F.max(F.size("v")), F.max(square), F.count("*")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], out)
    dim, top = max(dim, 1), max(top, 1)
    padded = F.concat("v", F.array_repeat(F.lit(0), F.lit(dim) - F.size("v")))
    # two 64-bit hashes stand for a vector with its label
    keyed = rows.withColumn("v", padded).withColumns({
        "k1": F.xxhash64(F.lit(1), "label", "v"), "k2": F.xxhash64("v", "label", F.lit(2))})
    shown = n_positives + 1
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    classes = keyed.withColumn("nth", nth).filter(F.col("nth") <= shown).groupBy("k1", "k2").agg(
        F.first("v").alias("v"), F.first("label").alias("label"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut_lineage(classes)
    miner = _tree_of(classes, top, dim, n)
    blocks = _blocks_of(classes, miner)
    own = keyed.filter("anchor").select("id", "k1", "k2")
    asked = cut_lineage(classes.join(own.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "v", "label"))

    def windows(slot, low, high):
        return {"slot": F.array(F.lit(slot).cast("long")), "low": F.array(low), "high": F.array(F.lit(high).cast("long"))}

    near = cut_lineage(_search(asked.withColumns(windows(0, F.lit(LEAST).cast("long"), -LEAST)), blocks, miner, shown, True, "own"))
    # from here on only rows at least as good as the last of the first ones are asked for
    bound = near.filter(F.col("place") == shown).select("k1", "k2", F.col("score").alias("least"))
    tight = asked.join(bound, ["k1", "k2"], "left").withColumns(
        windows(0, F.coalesce("least", F.lit(LEAST).cast("long")), -LEAST))
    rest = _search(tight, blocks, miner, shown, True, "rest")
    positives = cut_lineage(_listed(_best(near.drop("place").unionByName(rest.drop("place")), shown), ["k1", "k2"]))

    slots = F.array_sort(F.array_distinct(F.filter(F.transform("rows", lambda r: r["score"]), lambda s: s >= 0)))
    ceil = lambda s: F.floor((s * least + 99).cast("decimal(38,0)") / 100).cast("long")
    floor = lambda s: F.floor((s * most).cast("decimal(38,0)") / 100).cast("long")
    wanted = asked.join(positives, ["k1", "k2"]).withColumn("slot", F.filter(slots, lambda s: ceil(s) <= floor(s))).select(
        "k1", "k2", "v", "label", "slot", F.transform("slot", ceil).alias("low"), F.transform("slot", floor).alias("high"))
    negatives = _listed(_search(wanted, blocks, miner, n_negatives, False, "all"), ["k1", "k2", "slot"])
    by_class = negatives.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("slot", "rows"))).alias("found"))
    answer = positives.join(by_class, ["k1", "k2"])
    # a class has one answer and any number of anchors; the join's large keys can be split
    each = own.join(answer, ["k1", "k2"])
    at = F.array_position(F.transform("rows", lambda r: r["own"] & (r["id"] == F.col("id"))), F.lit(True))
    others = F.slice(F.filter(F.col("rows"), lambda r, i: i + 1 != at), 1, n_positives)
    pairs = each.select("id", F.explode(others).alias("p"), "found").select("id", "p", F.explode(F.col("found")[F.col("p")["score"]]).alias("q"))
    back = lambda c: F.nullif(c, F.lit(NO_ID))
    return pairs.select(back(F.col("id")).alias("anchor_id"), back(F.col("p")["id"]).alias("positive_id"), F.col("q")["place"].cast("int").alias("rank"),
                        back(F.col("q")["id"]).alias("negative_id"), F.col("p")["score"].alias("positive_score"), F.col("q")["score"].alias("negative_score"))
