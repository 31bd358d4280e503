"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with the
number of its earlier occurrences. A sketch takes, under a seed, the few
smallest labelled shingles and keeps them in the order of the text, so texts
with one sketch share shingles in one order. The similarity of two texts is
L / (n + m - L) for sequences of n and m shingles whose longest common
subsequence has L: the Jaccard similarity of labelled shingles if order
counts. One minus it is a metric (a transform of the indel distance).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import join_small, named, salted_join
from deltascope.llm.hashing import STEP_CODE, labelled, mix, shingles, text_slices, word_hashes
from deltascope.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
#: Sketches of a text and shingles in one. Two texts are compared if they share SHARED of them; at similarity 0.8
#: one sketch is shared with probability 0.8 ** ORDERED, and fewer than SHARED with probability 1e-6.
SKETCHES, ORDERED, SHARED = 24, 3, 2
#: Odd multipliers, each of which orders the shingles anew.
ORDERS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, (SKETCHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: One bit of each of BITS least shingles, by which pairs far below a similarity are passed over. Texts of
#: similarity s agree on at least (1 + s) / 2 of the bits, but for chance; DEVIATIONS of it are granted, so a pair at the
#: similarity is lost with probability 1e-5.
BITS, DEVIATIONS = 1024, 4.3
BIT_ORDERS = np.random.Generator(np.random.PCG64(78)).integers(1, 2**63, (BITS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BIT_COLUMNS = [f"b{i}" for i in range(BITS // 64)]
#: In place of a NULL id.
LAST = 2**63 - 1


def order_sketches(values: np.ndarray) -> np.ndarray:
    """Keys of the Order MinHash sketches of a sequence of labelled shingles.

    The shingles are well mixed numbers, so their products with an odd number
    are as good as a random order of them.
    """
    take = min(ORDERED, len(values))
    if not take:
        return np.zeros(0, dtype=np.int64)
    ranks = values[None, :] * ORDERS
    least = np.empty((SKETCHES, take), dtype=np.int64)
    each = np.arange(SKETCHES)
    for i in range(take):
        least[:, i] = at = ranks.argmin(axis=1)
        ranks[each, at] = np.uint64(2**64 - 1)
    least.sort(axis=1)  # back to the order of the text
    keys = (values[least] * STEP_CODE[20:20 + take]).sum(axis=1, dtype=np.uint64)
    return mix(keys + each.astype(np.uint64)).view(np.int64)


def least_bits(values: np.ndarray) -> np.ndarray:
    """One bit of the least shingle under each of many orders, packed into 64-bit numbers."""
    if not len(values):
        return np.zeros(BITS // 64, dtype=np.int64)
    least = np.empty(BITS, dtype=np.uint64)
    for i in range(0, BITS, 64):  # some orders at a time: the products of a long text are large
        least[i:i + 64] = (values[None, :] * BIT_ORDERS[i:i + 64]).min(axis=1)
    return np.packbits((mix(least) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def enough_bits(similarity: float) -> int:
    """Bits on which two texts of a similarity agree at least."""
    share = (1 + similarity) / 2
    return int(BITS * share - DEVIATIONS * (BITS * share * (1 - share)) ** 0.5)


def _alike(u: str, x: str, similarity: float) -> Column:
    """Whether the bits of two rows allow a similarity."""
    differ = [F.bit_count(F.col(f"{u}.{c}").bitwiseXOR(F.col(f"{x}.{c}"))) for c in BIT_COLUMNS]
    return reduce(Column.__add__, differ) <= BITS - enough_bits(similarity)


def band_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two sequences of labelled shingles, 0 if it is under ``least``.

    With similarity s there are at most (n + m)(1 - s)/(1 + s) insertions and
    deletions, so no aligned shingles lie further apart than that: the
    alignment stays inside the band. As labelled shingles differ within a
    text, the best alignment is the longest increasing run of matches.
    """
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return 1.0 if n == m else 0.0
    if min(n, m) < least * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = (n + m) * (1 - least) / (1 + least) + 1e-9
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(j) < least * (n + m - len(j)) - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        length = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        length = len(tails)
    similarity = length / (n + m - length)
    return similarity if similarity >= least - 1e-12 else 0.0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in text_slices(batch, 3):
            hashes, _, _, bounds = word_hashes(texts)
            runs = [labelled(shingles(hashes[bounds[i]:bounds[i + 1]], SHINGLE)) for i in range(len(texts))]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array([len(r) for r in runs], pa.int32()),
                 pa.array([order_sketches(r) for r in runs], pa.list_(pa.int64())),
                 *[pa.array(c) for c in np.array([least_bits(r) for r in runs]).T]],
                names=["doc_id", "t1", "t2", "size", "sketches", *BIT_COLUMNS])


def _compare(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: OrderedDict[int, np.ndarray] = OrderedDict()

        def sequence(key: int, text: str) -> np.ndarray:
            if key in ready:
                ready.move_to_end(key)
                return ready[key]
            hashes, _, _, _ = word_hashes([text or ""])
            ready[key] = out = labelled(shingles(hashes, SHINGLE))
            if len(ready) > 64:
                ready.popitem(last=False)
            return out

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [band_similarity(sequence(x, s.as_py()), sequence(y, t.as_py()), least)
                     for x, y, s, t in zip(a, b, batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found, pa.float64())],
                                             names=["a", "b", "similarity"])
    return compare


def _texts_of(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, text) of the nodes in ``wanted`` (id, doc_id, t1, t2)."""
    return join_small(rows, wanted, ["doc_id", "t1", "t2"]).select("id", "text").dropDuplicates(["id"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in text_slices(batch, 1):
            hashes, _, _, bounds = word_hashes(texts)
            runs = [labelled(shingles(hashes[bounds[i]:bounds[i + 1]], SHINGLE)) for i in range(len(texts))]
            ids = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), [len(r) for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(runs).view(np.int64))], names=["id", "shingle"])


def alone_counts(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, alone): shingles of a node that no other node in ``wanted`` (id, doc_id, t1, t2) has; no row if there are none."""
    found = _texts_of(wanted, rows).mapInArrow(_shingle_rows, "id long, shingle long")
    # labelled shingles differ within a text
    single = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter(F.col("n") == 1)
    return single.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("alone"))


def verify(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of pairs of nodes.

    ``nodes`` has (id, doc_id, t1, t2), one for each different text, ``rows``
    the texts under (doc_id, t1, t2). Only the texts in a pair are shuffled.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = cut_lineage(nodes.select("id", "doc_id", "t1", "t2").join(ends, "id", "left_semi"))
    involved = _texts_of(wanted, rows)
    counts = pairs.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.count()
    right = pairs.join(involved.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    left = involved.join(counts, "id").select(F.col("id").alias("a"), F.col("text").alias("text_a"), "n")
    both = salted_join(right, left, ["a"], "n", total, F.col("b")).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_compare(least), "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(id, class_id) of every id in the links, the class being the smallest id reached.

    Each round takes the smallest label of the neighbours and then the label
    of that label, so long chains halve. Only rows of linked ids move.
    """
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("class_id")))
    while True:
        around = (edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
                  .agg(F.min("class_id").alias("near")))
        lower = labels.join(around, "id").select("id", F.least("class_id", "near").alias("next"), F.col("class_id").alias("old"))
        jump = lower.select(F.col("id").alias("next"), F.col("next").alias("far"))
        moved = cut_lineage(lower.join(jump, "next", "left").select(
            "id", "old", F.least("next", F.coalesce("far", "next")).alias("class_id")))
        labels = moved.select("id", "class_id")
        if moved.filter(F.col("old") != F.col("class_id")).limit(1).count() == 0:
            return labels


def _sharing(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that come ``SHARED`` times or more."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED).select("a", "b")


def _compare_groups(groups: DataFrame, nodes: DataFrame, rows: DataFrame, threshold: float) -> DataFrame | None:
    """(id, class_id) of the texts that are linked to another; ``groups`` has (sketch, id, size), size in shingles.

    First the head of each group, the text that is in the largest groups (then
    the smallest id), is compared with the others, and classes are formed. Two
    texts that are in the head's class need no further link. So only the texts
    u outside it are compared with the texts x of the group that are in
    another class than u, if the sizes and the bits allow the threshold, and if
    the distances to the head do: the distance d is a metric, so
    |d(head, u) - d(head, x)| > 1 - threshold rules a link out. A shingle that no
    other of these texts has is in no common subsequence, so a text with many
    of those, such as a copy with words of its own, is linked to none. A group of
    copies with few other strangers thus costs its size times their number.
    """
    reach = 2 * threshold - 1  # similarities to the head are computed down to here
    sizes = groups.groupBy("sketch").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    sizes = cut_lineage(sizes)
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return None
    rows_of = cut_lineage(salted_join(groups, sizes.withColumn("n_rows", F.col("n")), ["sketch"], "n_rows", total, F.col("id")))
    popular = rows_of.groupBy("id").agg(F.sum("n").alias("popularity"))
    ranked = cut_lineage(rows_of.join(popular, "id"))
    best = F.max_by("id", F.struct("popularity", -F.col("id")))
    heads = cut_lineage(ranked.groupBy("sketch").agg(F.count(F.lit(1)).alias("n"), best.alias("head")))
    members = cut_lineage(salted_join(ranked.select("sketch", "id", "size"), heads, ["sketch"], "n", total, F.col("id")))
    bits = nodes.select("id", *BIT_COLUMNS)
    stars = cut_lineage(_sharing(members.filter(F.col("id") != F.col("head")).select(F.col("head").alias("a"), F.col("id").alias("b"))))
    near = (stars.join(bits.withColumnRenamed("id", "a").alias("u"), "a").join(bits.withColumnRenamed("id", "b").alias("x"), "b")
            .select("a", "b", _alike("u", "x", reach).alias("alike")))
    near = cut_lineage(near)
    found = verify(near.filter("alike").select("a", "b"), nodes, rows, reach)
    found = cut_lineage(found.unionByName(near.filter("NOT alike").select("a", "b", F.lit(0.0).alias("similarity"))))
    labels = components(found.filter(F.col("similarity") >= threshold))

    own, of_head = labels.select("id", F.col("class_id").alias("own")), labels.select(F.col("id").alias("head"), F.col("class_id").alias("of_head"))
    state = (members.join(own, "id", "left").join(of_head, "head", "left")
             .join(found.select(F.col("a").alias("head"), F.col("b").alias("id"), "similarity"), ["head", "id"], "left"))
    is_head = F.col("id") == F.col("head")
    far = 1 - reach + 1e-6
    state = cut_lineage(state.select(
        "sketch", "id", "size", F.coalesce("own", -1 - F.col("id")).alias("own"),
        (is_head | F.coalesce(F.col("own") == F.col("of_head"), F.lit(False))).alias("settled"),
        F.when(is_head, 0.0).when(F.col("similarity") > 0, 1 - F.col("similarity")).when(F.col("similarity") == 0, far).otherwise(0.0).alias("least"),
        F.when(is_head, 0.0).when(F.col("similarity") > 0, 1 - F.col("similarity")).otherwise(1.0).alias("most")))
    strangers = state.filter(~F.col("settled"))
    if strangers.limit(1).count() == 0:
        return labels
    slack = 1 - threshold + 1e-9
    full = nodes.select("id", "sketches", *BIT_COLUMNS)
    busy = cut_lineage(state.join(strangers.select("sketch").distinct(), "sketch", "left_semi"))
    wanted = cut_lineage(nodes.select("id", "doc_id", "t1", "t2").join(busy.select("id").distinct(), "id", "left_semi"))
    alone = cut_lineage(alone_counts(wanted, rows))
    busy = (busy.join(alone, "id", "left").withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone")
            .join(full, "id"))
    # a head with words of its own leaves many unlinked: those are compared once more, with the text of its class that has the fewest
    busy = cut_lineage(busy)
    centres = busy.filter("settled").groupBy("sketch").agg(F.max_by("id", F.struct("common", -F.col("id"))).alias("centre"))
    centre = busy.join(centres, "sketch").filter(F.col("id") == F.col("centre")).drop("centre")
    u, x = busy.filter(~F.col("settled")).alias("u"), centre.alias("x")
    close = ((F.col("u.sketch") == F.col("x.sketch"))
             & (F.least("u.size", "x.size") >= threshold * F.greatest("u.size", "x.size") - 1e-9)
             & (F.least("u.common", "x.common") * (1 + threshold) >= threshold * (F.col("u.size") + F.col("x.size")) - 1e-9)
             & _alike("u", "x", threshold))
    known = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = u.join(x, close).select(F.least("u.id", "x.id").alias("a"), F.greatest("u.id", "x.id").alias("b")).distinct()
    pairs = cut_lineage(pairs.join(known, ["a", "b"], "left_anti"))
    again = cut_lineage(verify(pairs, nodes, rows, threshold).filter(F.col("similarity") >= threshold))
    found = cut_lineage(found.unionByName(again.select(found.columns)))
    known = known.unionByName(pairs)
    labels = components(found.filter(F.col("similarity") >= threshold))
    # own of the head, which is settled, is that of all settled ones of its group
    own = labels.select("id", F.col("class_id").alias("now"))
    busy = busy.join(own, "id", "left").withColumn("own", F.coalesce("now", "own")).drop("now")
    of_group = busy.filter("settled").groupBy("sketch").agg(F.first("own").alias("of_head"))
    busy = cut_lineage(busy.join(of_group, "sketch").withColumn("settled", F.col("settled") | (F.col("own") == F.col("of_head"))).drop("of_head"))
    u, x = busy.filter(~F.col("settled")).alias("u"), busy.alias("x")
    shared = F.array_intersect("u.sketches", "x.sketches")
    others = u.join(x, (
        close & (F.col("u.own") != F.col("x.own")) & (F.col("x.settled") | (F.col("u.id") < F.col("x.id")))
        & (F.col("u.least") - F.col("x.most") <= slack) & (F.col("x.least") - F.col("u.most") <= slack)
        # in one of the groups that have both
        & (F.size(shared) >= SHARED) & (F.array_min(shared) == F.col("u.sketch"))))
    pairs = others.select(F.least("u.id", "x.id").alias("a"), F.greatest("u.id", "x.id").alias("b"))
    pairs = cut_lineage(pairs.join(known, ["a", "b"], "left_anti"))
    more = cut_lineage(verify(pairs, nodes, rows, threshold).filter(F.col("similarity") >= threshold))
    return components(found.filter(F.col("similarity") >= threshold).unionByName(more))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Class of each document: doc_id, class_id (smallest id of the class), copies (rows with this very text).

    Equal texts are one class from the start and are compared once. A NULL
    text counts as empty, and texts without words are in a class only with
    equal texts; one of fewer than five words is one shingle. Classes join
    all texts linked directly or over others. NULL ids rank last and get
    class_id of their class all the same. Repeated rows stay repeated; other
    columns are left out.
    """
    out = _classes(docs, id_column, text_column, threshold)
    return out.select(F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"),
                      F.when(F.col("class_id") < LAST, F.col("class_id")).alias("class_id"), "copies")


def _keys(id_column: str, text_column: str) -> dict[str, Column]:
    """Id, NULL as the last one, and two hashes of the text, by which a row is found again."""
    text = F.coalesce(named(text_column), F.lit(""))
    return {"doc_id": F.coalesce(named(id_column).cast("long"), F.lit(LAST)), "t1": F.xxhash64(text),
            "t2": F.xxhash64(F.lit(7), text, F.length(text))}


def _classes(docs: DataFrame, id_column: str, text_column: str, threshold: float) -> DataFrame:
    """doc_id, t1, t2, class_id, copies of each row."""
    own = docs.select(*[c.alias(n) for n, c in _keys(id_column, text_column).items()],
                      F.coalesce(named(text_column), F.lit("")).alias("text"))
    sketched = cut_lineage(own.mapInArrow(_sketch, "doc_id long, t1 long, t2 long, size int, sketches array<long>, " + ", ".join(f"{c} long" for c in BIT_COLUMNS)))
    # one node for each different text, numbered when this table is written
    nodes = sketched.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"),
                                             F.first("size").alias("size"), F.first("sketches").alias("sketches"),
                                             *[F.first(c).alias(c) for c in BIT_COLUMNS])
    nodes = cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()))
    labels = _compare_groups(nodes.select(F.explode(F.array_distinct("sketches")).alias("sketch"), "id", "size"),
                             nodes.select("id", "doc_id", "t1", "t2", "sketches", *BIT_COLUMNS), own, threshold)
    classes = nodes.select("id", "t1", "t2", "doc_id", "copies").withColumnRenamed("doc_id", "first_doc")
    if labels is None:
        classes = classes.withColumnRenamed("first_doc", "class_id")
    else:
        linked = cut_lineage(labels.withColumnRenamed("class_id", "component").join(classes.select("id", "first_doc"), "id"))
        smallest = linked.groupBy("component").agg(F.min("first_doc").alias("class_id"))
        sizes = linked.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        named_ = salted_join(linked, smallest.join(sizes, "component"), ["component"], "n", linked.count(), F.col("id"))
        classes = classes.join(named_.select("id", "class_id"), "id", "left").withColumn("class_id", F.coalesce("class_id", "first_doc"))
    out = salted_join(sketched.select("doc_id", "t1", "t2"), classes.select("t1", "t2", "class_id", "copies", F.col("copies").alias("n")),
                      ["t1", "t2"], "n", sketched.count(), F.col("doc_id"))
    return out


def first_of_classes(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id",
                     threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all its columns: that of the smallest id; of rows equal in id and text, one.

    Only rows that come several times are shuffled whole.
    """
    classes = cut_lineage(_classes(docs, id_column, text_column, threshold))
    per_text = classes.groupBy("doc_id", "t1", "t2", "class_id").agg(F.count(F.lit(1)).alias("n"))
    # texts of one class may share the smallest id
    first = (per_text.filter(F.col("doc_id") == F.col("class_id")).groupBy("class_id")
             .agg(F.min(F.struct("t1", "t2")).alias("first")))
    is_first = (F.col("doc_id") == F.col("class_id")) & (F.struct("t1", "t2") == F.col("first"))
    names = {"doc_id": "_head_id", "t1": "_head_t1", "t2": "_head_t2"}
    # all but the first rows of the classes, and the first ones that come several times
    listed = per_text.join(first, "class_id").filter(~is_first | (F.col("n") > 1)).select(
        *[F.col(c).alias(n) for c, n in names.items()], is_first.alias("_several"))
    listed = cut_lineage(listed)
    keyed = docs.withColumns({names[n]: c for n, c in _keys(id_column, text_column).items()})
    on = list(names.values())
    single = join_small(keyed, listed.select(*on), on, "left_anti")
    several = join_small(keyed, listed.filter("_several").select(*on), on, "left_semi").dropDuplicates(on)
    return single.unionByName(several).drop(*on)
