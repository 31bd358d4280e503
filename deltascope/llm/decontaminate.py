"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

Items are the indexed documents, passages of the training texts the queries.
Passages are windows of twice the longest item, half a window apart, so any
item lies in one of them. An item is retrieved if its BM25 score for the
passage's distinct words is at least a share of its score for its own words;
impacts are stored as shares of that, so one threshold serves all items.

Each item has key words: its rarest ones, without which it can't reach half of
the threshold. A screen adds up the impacts of the key words of each passage,
for all passages at once; where these and all other words of an item together
stay below the threshold, block-max WAND could have found no pivot. It runs
over the whole passage for all that are left. A retrieved item is then verified: enough of the five-word shingles of its
question, and of its answer, must be in the passage, or nearly all of its words in their order; an item without an answer
is verified as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import named
from deltascope.llm.hashing import shingles, text_slices, word_hashes
from deltascope.session import cut_lineage

K1, B = 1.2, 0.75
#: Share of an item's own score that retrieves it, and share of shingles that verifies it.
RETRIEVE, OVERLAP = 0.6, 0.5
SHINGLE = 5
#: Share of a part's words that may be changed, left out or put in where too few shingles are left; one word of so many at least.
EDITS, LEAST_EDITED = 0.2, 3
#: Postings in a block of a list.
BLOCK = 16
#: Items in one index; more items take more passes over the texts, each with an index of bounded size.
INDEX_ITEMS = 5_000
LEAST_WINDOW = 64


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's question goes up to its last question mark; without one, or with nothing after it, the item is all question."""
    cut = text.rfind("?") + 1
    if 0 < cut < len(text.rstrip()):
        return text[:cut], text[cut:]
    return text, ""


def grams(words: np.ndarray) -> np.ndarray:
    return np.unique(shingles(words, SHINGLE))


def edits(part: np.ndarray, words: np.ndarray) -> int:
    """Fewest words to change, leave out or put in that turn some run of ``words`` into ``part``."""
    at = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64)  # by the end of the run; it may begin anywhere
    for i, word in enumerate(part):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (words != word), out=new[1:])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def overlap(part: np.ndarray, words: np.ndarray) -> float:
    """Share of the shingles of ``part`` that ``words`` has; 1 for an empty part.

    One changed word takes up to five shingles with it. So where less than
    ``OVERLAP`` of them are left, it is the share of words left in place by
    the best alignment, if no more than ``EDITS`` of them are edited.
    """
    if not len(part):
        return 1.0
    k = min(SHINGLE, len(part))
    share = float(np.isin(np.unique(shingles(part, k)), shingles(words, k)).mean()) if len(words) >= k else 0.0
    most = max(int(EDITS * len(part)), int(len(part) >= LEAST_EDITED))
    if share >= OVERLAP or np.count_nonzero(~np.isin(part, words)) > most:
        return share
    n = edits(part, words)
    return max(share, 1 - n / len(part)) if n <= most else share


@dataclass
class Index:
    """Postings of the items' words. Lists are sorted by item number; impacts are shares of the item's own score."""
    vocabulary: np.ndarray
    lists: list[np.ndarray]
    impacts: list[np.ndarray]
    most: np.ndarray
    block_most: list[np.ndarray]
    item_ids: list[int | None]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    window: int
    step: int
    key_starts: np.ndarray  # of each word: its range in the next two
    key_items: np.ndarray
    key_impacts: np.ndarray
    other: np.ndarray  # of each item: the impacts of its other words together


def build_index(items: list[tuple[int | None, str]], frequency: dict[int, int], n_items: int, mean_words: float,
                window: int) -> Index:
    """Index of a block of items, with the word frequencies and the mean length of all items."""
    entries: dict[int, list[tuple[int, float]]] = {}
    questions, answers, ids = [], [], []
    for item_id, text in items:
        words = word_hashes([text])[0]
        if not len(words):
            continue
        number = len(ids)
        ids.append(item_id)
        q, a = question_and_answer(text)
        questions.append(word_hashes([q])[0])
        answers.append(word_hashes([a])[0])
        values, counts = np.unique(words, return_counts=True)
        scores = []
        for v, tf in zip(values.tolist(), counts.tolist()):
            df = frequency[v]
            idf = math.log(1 + (n_items - df + 0.5) / (df + 0.5))
            scores.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words)))
        own = sum(scores)
        for v, s in zip(values.tolist(), scores):
            entries.setdefault(v, []).append((number, s / own))
    vocabulary = np.array(sorted(entries), dtype=np.uint64)
    lists = [np.array([n for n, _ in entries[v]], dtype=np.int64) for v in vocabulary.tolist()]
    impacts = [np.array([s for _, s in entries[v]]) for v in vocabulary.tolist()]
    block_most = [np.array([x[i:i + BLOCK].max() for i in range(0, len(x), BLOCK)]) for x in impacts]
    most = np.array([x.max() for x in impacts])
    own: list[list[tuple[int, float, int]]] = [[] for _ in ids]
    for t, (items_, shares) in enumerate(zip(lists, impacts)):
        for i, s in zip(items_.tolist(), shares.tolist()):
            own[i].append((len(items_), -s, t))
    keys: list[list[tuple[int, float]]] = [[] for _ in lists]
    other = np.zeros(len(ids))
    for i, words in enumerate(own):
        rest = 1.0
        for _, negative, t in sorted(words):  # rarest first
            if rest < RETRIEVE / 2:
                break
            keys[t].append((i, -negative))
            rest += negative
        other[i] = rest
    flat = [x for k in keys for x in k]
    return Index(vocabulary, lists, impacts, most, block_most, ids, questions, answers, window, window // 2,
                 np.concatenate([[0], np.cumsum([len(k) for k in keys])]), np.array([i for i, _ in flat], dtype=np.int64),
                 np.array([s for _, s in flat]), other)


def block_max_wand(index: Index, terms: list[int], least: float) -> list[tuple[int, float]]:
    """All (item number, score) with a score of at least ``least`` for a passage's distinct words."""
    least -= 1e-9
    found: list[tuple[int, float]] = []
    cursors = [[int(index.lists[t][0]), 0, t] for t in terms]  # current item, position, term
    end = len(index.item_ids)
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for i, (_, _, t) in enumerate(cursors):
            bound += index.most[t]
            if bound >= least:
                pivot = i
                break
        if pivot < 0:
            return found
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # bound by the blocks in which the item may be
        block_bound, border = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
        for i in range(pivot + 1):
            _, at, t = cursors[i]
            items = index.lists[t]
            block = max(at, int(np.searchsorted(items, item))) // BLOCK
            if block < len(index.block_most[t]):
                block_bound += index.block_most[t][block]
                border = min(border, int(items[min((block + 1) * BLOCK, len(items)) - 1]) + 1)
        if block_bound >= least:
            score, target = 0.0, item + 1
            for i in range(pivot + 1):
                _, at, t = cursors[i]
                items = index.lists[t]
                at += int(np.searchsorted(items[at:], item))
                if at < len(items) and items[at] == item:
                    score += index.impacts[t][at]
            if score >= least:
                found.append((item, score))
        else:
            target = max(item + 1, border)
        for c in cursors[:pivot + 1]:
            items = index.lists[c[2]]
            c[1] += int(np.searchsorted(items[c[1]:], target))
            c[0] = int(items[c[1]]) if c[1] < len(items) else end
        cursors = [c for c in cursors if c[0] < end]
    return found


def passages(n_words: np.ndarray, window: int, step: int) -> np.ndarray:
    """Number of windows of each text: one for any text with words, then one for each further step."""
    more = np.maximum(0, -(-(n_words - window) // step))
    return np.where(n_words > 0, 1 + more, 0)


def search(index: Index, texts: list[str], retrieve: float = RETRIEVE, least_overlap: float = OVERLAP) -> list[tuple]:
    """(text number, item id, score, question overlap, answer overlap) of each verified item of each text; best passage."""
    if len(index.other) and retrieve <= index.other.max():
        raise ValueError("the key words were chosen for a higher threshold")
    hashes, _, _, bounds = word_hashes(texts)
    if not len(hashes) or not len(index.vocabulary):
        return []
    at = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
    met = index.vocabulary[at] == hashes
    windows = passages(np.diff(bounds), index.window, index.step)
    first = np.concatenate([[0], np.cumsum(windows)])
    if not len(index.item_ids) or not first[-1]:
        return []

    # (window, key word), each once
    known = np.flatnonzero(met & (np.diff(index.key_starts) > 0)[at])
    owner = np.searchsorted(bounds, known, side="right") - 1
    late = (known - bounds[owner]) // index.step  # a word is in this window and the one before
    pairs = []
    for back in (0, 1):
        w = late - back
        ok = (w >= 0) & (w < windows[owner])
        pairs.append((first[owner[ok]] + w[ok]) * len(index.vocabulary) + at[known[ok]])
    window_of, term_of = np.divmod(np.unique(np.concatenate(pairs)), len(index.vocabulary))
    # the screen: impacts of the key words by (window, item)
    n = index.key_starts[term_of + 1] - index.key_starts[term_of]
    entry = np.repeat(index.key_starts[term_of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    cell = np.repeat(window_of, n) * len(index.item_ids) + index.key_items[entry]
    order = np.argsort(cell, kind="stable")
    cell, share = cell[order], index.key_impacts[entry[order]]
    if not len(cell):
        return []
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sums = np.add.reduceat(share, heads)
    hopeful = np.unique(cell[heads][sums + index.other[cell[heads] % len(index.item_ids)] >= retrieve - 1e-9] // len(index.item_ids))
    best: dict[tuple[int, int], tuple] = {}
    for w in hopeful.tolist():
        text = int(np.searchsorted(first, w, side="right")) - 1
        a = int(bounds[text]) + (w - int(first[text])) * index.step
        z = min(a + index.window, int(bounds[text + 1]))
        words = hashes[a:z]
        got = block_max_wand(index, np.unique(at[a:z][met[a:z]]).tolist(), retrieve)
        for item, score in got:
            q, r = overlap(index.questions[item], words), overlap(index.answers[item], words)
            if min(q, r) >= least_overlap and score > best.get((text, item), (0.0,))[0]:
                best[text, item] = (score, q, r)
    return [(t, index.item_ids[i], *v) for (t, i), v in sorted(best.items())]


def indexes(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[Index]:
    """Indexes of blocks of items; word frequencies and lengths are counted over all items by Spark."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, 2):
                hashes, _, _, bounds = word_hashes(texts)
                rows = [np.unique(hashes[bounds[i]:bounds[i + 1]]).view(np.int64) for i in range(len(texts))]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(np.diff(bounds)), pa.array(rows, pa.list_(pa.int64()))],
                    names=["block", "item_id", "text", "n_words", "words"])

    n = items.count()
    blocks = max(1, -(-n // INDEX_ITEMS))
    own = items.select(F.pmod(F.xxhash64(named(id_column), named(text_column)), F.lit(blocks)).cast("int").alias("block"),
                       named(id_column).cast("long").alias("item_id"), named(text_column).alias("text"))
    rows = cut_lineage(own.mapInArrow(terms, "block int, item_id long, text string, n_words long, words array<long>"))
    n_items, mean, longest = rows.filter("n_words > 0").agg(F.count(F.lit(1)), F.avg("n_words"), F.max("n_words")).first()
    if not n_items:
        return
    frequency = rows.select("block", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("block").alias("blocks"))
    frequency = cut_lineage(frequency.select(F.explode("blocks").alias("block"), "word", "n"))
    for block in range(blocks):
        some = rows.filter(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").collect()
        counts = frequency.filter(F.col("block") == block).select("word", "n").collect()
        yield build_index([(r[0], r[1] or "") for r in some], {int(np.int64(w).view(np.uint64)): c for w, c in counts},
                          n_items, float(mean), max(LEAST_WINDOW, 2 * longest))


def find_leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified pairs: doc_id, item_id, score, question_overlap, answer_overlap; the last is 1 for an item without an answer.

    Texts and items that are NULL, empty or without words pair with nothing;
    NULL ids are kept as they are; repeated documents and repeated items give
    repeated pairs. Other columns are left out.
    """
    out = None
    for index in indexes(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, _, texts in text_slices(batch, 1):
                    hits = search(sent.value, texts)
                    columns = [[ids[a + h[0]] for h in hits], *[[h[i] for h in hits] for i in range(1, 5)]]
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                     names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text")).mapInArrow(
            look, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns; nothing is shuffled."""
    columns = docs.columns
    at = columns.index(text_column)
    docs = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # names with dots can't go through Arrow
    for index in indexes(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for a, _, texts in text_slices(batch, at):
                    for hit in search(sent.value, texts):
                        clean[a + hit[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs.toDF(*columns)
