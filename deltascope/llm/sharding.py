"""Exact uniform shuffle into shards by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltascope.llm.common import named
from deltascope.session import cut_lineage

SHARDS = 24
#: Rows in a block, about: what one task permutes.
BLOCK_ROWS = 50_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` from ``good + bad``, for populations of any size.

    numpy's own generator ends at 10**9, so the inverse of the distribution
    is used: its ratios of neighbours are summed up over 12 standard
    deviations around the mode.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low >= high:
        return low
    total = good + bad
    mode = min(high, max(low, ((drawn + 1) * (good + 1)) // (total + 2)))
    var = drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1))
    reach = int(12 * math.sqrt(var)) + 12
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    log_ratio = np.log((good - k) / (k + 1)) + np.log((drawn - k) / (bad - drawn + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(log_ratio)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, b - a))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows that each block sends to each shard, if all orders are equally likely.

    Row and column sums are the given sizes. Each row is drawn shard by shard
    from what the shards have left.
    """
    rng = np.random.default_rng(seed)
    left = [int(s) for s in shards]
    out = np.zeros((len(blocks), len(shards)), dtype=np.int64)
    for i, size in enumerate(blocks):
        need, pool = int(size), sum(left)
        for j, have in enumerate(left):
            pool -= have
            out[i, j] = got = hypergeometric(rng, have, pool, need)
            left[j] -= got
            need -= got
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def shuffle_to_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 11, id_column: str = "doc_id",
                      text_column: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Shard and slot of each row: a uniform shuffle with shard sizes at most one apart.

    Returns doc_id, size (UTF-8 bytes of the text plus 8, a NULL text has
    none), text_crc32, law ``rows``, shard, slot (gapless from 0 in a shard)
    and grown_shard, NULL under this law. Rows are dealt to blocks by a hash of
    the row. A task orders a block by random keys, sends the first rows to
    shard 0, the next to shard 1 and so on, as many as the matrix says, and
    each shard is ordered anew by other random keys, in pieces whose counts are
    summed. Random keys come from the row's own values, so a task that runs
    again gives the same rows. Equal rows, also with a NULL id, are numbered
    first and count as rows of their own. To the driver go the block sizes,
    one number for ``block_rows`` rows. An empty table gives no rows; other
    columns are left out.
    """
    text = named(text_column)
    raw = F.coalesce(text, F.lit("")).cast("binary")
    keyed = docs.select(named(id_column).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"),
                        F.crc32(raw).alias("text_crc32"))
    n = keyed.count()
    n_blocks = max(1, math.ceil(n / block_rows))
    # equal rows get numbers within their input partition, so a crowd of them spreads over the blocks
    own = F.monotonically_increasing_id()
    rows = cut_lineage(keyed.withColumn("_own", own))
    mark = F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32", "_own")
    rows = rows.withColumn("_block", F.pmod(mark, F.lit(n_blocks)).cast("int"))
    sizes = dict(rows.groupBy("_block").count().collect())
    matrix = communication_matrix([sizes.get(b, 0) for b in range(n_blocks)], shard_sizes(n, shards), seed)
    ends = docs.sparkSession.createDataFrame(
        [(b, [int(x) for x in np.cumsum(row)]) for b, row in enumerate(matrix)], "_block int, _ends array<long>")

    inside = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), "_own", "doc_id"), "_own")
    sent = rows.withColumn("_nth", F.row_number().over(inside))
    if n_blocks * shards <= 1_000_000:
        ends = F.broadcast(ends)
    sent = sent.join(ends, "_block").withColumn(
        "shard", F.size(F.filter("_ends", lambda e: e < F.col("_nth"))).cast("int"))

    # the second permutation: pieces of a shard are ranges of its random keys
    pieces = max(1, math.ceil(n / shards / block_rows))
    second = F.xxhash64(F.lit(seed + 2), "_own", "doc_id", "shard")
    piece = F.shiftrightunsigned(second, 33) * pieces / F.lit(1 << 31)
    sent = cut_lineage(sent.select("doc_id", "size", "text_crc32", "_own", "shard", second.alias("_key"),
                                   F.floor(piece).cast("int").alias("_piece")))
    counts = sent.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_piece").orderBy("_key", "_own")
    return (sent.withColumn("_rank", F.row_number().over(within)).join(offsets, ["shard", "_piece"])
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("_rank") - 1 + F.col("_before")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
