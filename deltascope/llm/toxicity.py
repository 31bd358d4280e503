"""Toxicity by a support vector machine over gapped character subsequences.

The kernel of two strings sums, over all subsequences of four letters they share, the
decay to the power of the room these take in both; it is divided by the strings' own
kernels. Characters that are neither letters nor digits only take room, so ``i-d-i-o-t``
is close to ``idiot``, and one more letter costs a part of the value.

Sentences are compared with landmark strings: a feature is the greatest kernel of any
word of the sentence with a landmark. The landmarks' own kernel matrix
turns features into those of the Nyström approximation, and a linear machine with squared
hinge loss is trained on them by Newton steps. Each step is one pass over the labelled
sentences that adds up a matrix of the landmarks' size, so all sentences take part and the
driver holds nothing that grows with them. A text's score is a logistic curve over its worst
sentence and the sum of all, fitted in the same way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import named
from deltascope.session import cut_lineage

#: Letters of a subsequence, and decay for each place it takes.
LENGTH, DECAY = 4, 0.8
LANDMARKS = 48
#: Strings by document counts of which landmarks are chosen by counts of contexts.
CANDIDATES = 1000
#: Least logarithm of the odds of a landmark in toxic against clean texts.
ODDS = 2.0
LANDMARK_CHARS = 18
#: Part of a landmark's letters that a string must have in the same order, else their kernel counts as 0.
SHARED = 0.75
#: Longer words are read in windows of so many characters that overlap by half.
UNIT_CHARS = 26
#: Characters that mark the start and end of a word, and count as letters.
START, END = "\x02", "\x03"
#: Weight of the norm in the loss, in sentences.
RIDGE = 10.0
STEPS = 25
#: Labelled rows, about so many, that are learned from.
LEARNED_ROWS = 20_000
#: Characters of a text that are read together.
PART_CHARS = 1_000_000
#: Words remembered in a task, and those of them with features.
KNOWN_WORDS, KNOWN_HITS = 300_000, 30_000

SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+|\n+")
FULL_END = re.compile(r"[。！？]+")
SPELLED = re.compile(r"(?<!\S)\w(?:[ \t]+\w){3,}(?!\S)")
EDGE = ".,;:!?\"'()[]{}<>#$%&*|@^~`_+=/\\-–—…«»“”„¡¿。！？"


def parts(text: str | None) -> Iterator[str]:
    """The text in lower case, cut at sentence ends into parts of about ``PART_CHARS``.

    Letters that stand alone in a row are put together; a full-width sentence end gets a space.
    """
    text = (text or "").lower()
    at = 0
    while at < len(text):
        end = SENTENCE_END.search(text, at + PART_CHARS) if len(text) - at > PART_CHARS else None
        part = text[at:end.end() if end else len(text)]
        at += len(part)
        if not part.isascii():
            part = FULL_END.sub(lambda m: m.group() + " ", part)
        yield SPELLED.sub(lambda m: "".join(m.group().split()), part)


def units(word: str) -> list[str]:
    """A word without marks at its edges, between marks of its start and end, or its windows if it is long."""
    plain = word.strip(EDGE)
    if len(plain) < LENGTH:
        return []
    whole = f"{START}{plain}{END}"
    if len(whole) <= UNIT_CHARS:
        return [whole]
    half = UNIT_CHARS // 2
    return [whole[i:i + UNIT_CHARS] for i in range(0, len(whole) - half, half)]


def codes(strings: list[str], width: int) -> np.ndarray:
    """Code points by place; 0 for what is neither letter, digit nor mark of an edge, and after the end."""
    if not strings:
        return np.zeros((0, width), np.int32)
    out = np.array(strings, dtype=f"U{width}").view(np.int32).reshape(len(strings), width).copy()
    for c in np.unique(out).tolist():
        if not (chr(c).isalnum() or chr(c) in (START, END)):
            out[out == c] = 0
    return out


def subsequence_kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gap-weighted kernel of the strings in the same rows of two code tables."""
    n, width = y.shape
    place = np.arange(width)
    step = np.where(place[None, :] >= place[:, None], DECAY ** (place[None, :] - place[:, None] + 2.0), 0.0).astype(np.float32)
    # ways[i][:, k]: weight of i letters matched in x so far and the first k of y, room counted up to there
    ways = [np.ones((n, width + 1), np.float32), *(np.zeros((n, width + 1), np.float32) for _ in range(LENGTH - 1))]
    total = np.zeros(n)
    for p in range(x.shape[1]):
        here = x[:, p:p + 1]
        same = ((y == here) & (here != 0)).astype(np.float32)
        total += DECAY**2 * np.einsum("ij,ij->i", same, ways[LENGTH - 1][:, :-1])
        for i in range(LENGTH - 1, 0, -1):
            ways[i] *= np.float32(DECAY)
            ways[i][:, 1:] += (same * ways[i - 1][:, :-1]) @ step
    return total


class Landmarks:
    """Landmark strings, and the normalised kernel of other strings with all of them."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.codes = codes(strings, LANDMARK_CHARS)
        self.own = subsequence_kernel(self.codes, self.codes)
        self.longest = max(map(len, strings), default=0)
        self.least = [max(LENGTH, int(np.ceil(SHARED * len(s)))) for s in strings]
        self._pack()

    def _pack(self) -> None:
        """A bit for each letter, several landmarks to a 64-bit word with one bit between them."""
        self.where, word, at = [], 0, 0
        for s in self.strings:
            if at + len(s) + 1 > 64:
                word, at = word + 1, 0
            self.where.append((word, at, len(s)))
            at += len(s) + 1
        self.fields = np.zeros(word + 1, np.uint64)
        letters = sorted({c for c in self.codes.ravel().tolist() if c})
        self.letter = {c: i + 1 for i, c in enumerate(letters)}
        self.masks = np.zeros((len(letters) + 1, word + 1), np.uint64)
        for (w, a, n), row in zip(self.where, self.codes):
            self.fields[w] |= np.uint64((2**n - 1) << a)
            for i in range(n):
                if row[i]:
                    self.masks[self.letter[int(row[i])], w] |= np.uint64(1 << (a + i))

    def sharing(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(strings, landmarks) that have enough letters in the same order in common."""
        table = np.zeros(max(int(x.max(initial=0)), max(self.letter, default=0)) + 1, np.int32)
        for c, i in self.letter.items():
            table[c] = i
        ends = np.where(x != 0, np.arange(1, x.shape[1] + 1), 0).max(axis=1, initial=0)
        order = np.argsort(-ends, kind="stable")
        letters = table[x[order]]
        left = np.broadcast_to(self.fields, (len(x), len(self.fields))).copy()
        for p in range(x.shape[1]):
            n = int((ends > p).sum())
            if not n:
                break
            v = left[:n]
            u = v & self.masks[letters[:n, p]]
            left[:n] = ((v + u) | (v - u)) & self.fields
        found = []
        for j, (w, a, n) in enumerate(self.where):
            common = np.bitwise_count(~left[:, w] & np.uint64((2**n - 1) << a))
            rows = order[np.flatnonzero(common >= self.least[j])]
            found.append((rows, np.full(len(rows), j)))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def features(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.strings)), np.float32)
        if not strings or not self.strings:
            return out
        x = codes(strings, UNIT_CHARS)
        rows, marks = self.sharing(x)
        sizes = np.array([len(s) for s in strings])
        own = np.zeros(len(strings))
        used = np.unique(rows)
        for r in self._chunks(used, sizes):
            some = x[r, :sizes[r].max()]
            own[r] = subsequence_kernel(some, some)
        for c in self._chunks(np.arange(len(rows)), sizes[rows]):
            r, m = rows[c], marks[c]
            k = subsequence_kernel(x[r, :sizes[r].max()], self.codes[m, :self.longest])
            out[r, m] = k / np.sqrt(own[r] * self.own[m])
        return out

    @staticmethod
    def _chunks(which: np.ndarray, sizes: np.ndarray, n: int = 2048) -> Iterator[np.ndarray]:
        """Parts of about equal sizes."""
        order = which[np.argsort(sizes[which], kind="stable")]
        return (order[at:at + n] for at in range(0, len(order), n))

    def root(self) -> np.ndarray:
        """Inverse square root of the landmarks' kernel matrix."""
        values, vectors = np.linalg.eigh(self.features(self.strings).astype(np.float64))
        kept = values > 1e-3
        return vectors[:, kept] / np.sqrt(values[kept]) @ vectors[:, kept].T


class Reader:
    """Features of words; those met before are remembered, up to a bound."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.plain: set[str] = set()
        self.hits: dict[str, np.ndarray] = {}

    def meet(self, words: set[str]) -> None:
        if len(self.plain) > KNOWN_WORDS or len(self.hits) > KNOWN_HITS:
            self.plain, self.hits = set(), {}
        new = sorted(words - self.plain - self.hits.keys())
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            cut = [units(w) for w in some]
            table = self.landmarks.features([u for c in cut for u in c])
            owner = np.repeat(np.arange(len(some)), [len(c) for c in cut])
            for i in np.flatnonzero(table.any(axis=1)):
                w = some[owner[i]]
                self.hits[w] = np.maximum(self.hits[w], table[i]) if w in self.hits else table[i].copy()
            self.plain.update(w for w in some if w not in self.hits)

    def sentences(self, part: str) -> Iterator[tuple[str, np.ndarray]]:
        """(sentence, greatest kernel with each landmark) for the sentences that have any."""
        hits = self.hits
        for s in SENTENCE_END.split(part):
            rows = [hits[w] for w in s.split() if w in hits]
            if rows:
                yield s, rows[0] if len(rows) == 1 else np.max(rows, axis=0)


def pieces(batch: pa.RecordBatch, text_at: int, chars: int = 200_000) -> Iterator[list[tuple[int, str, list[str]]]]:
    """(row, part of its text, words of the part) for slices of a batch."""
    out: list[tuple[int, str, list[str]]] = []
    size = 0
    for i, cell in enumerate(batch.column(text_at)):
        for part in parts(cell.as_py()):
            out.append((i, part, part.split()))
            size += len(part)
            if size > chars:
                yield out
                out, size = [], 0
    if out:
        yield out


def _batch(columns: list, kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names.split())


def choose_landmarks(labelled: DataFrame) -> list[str]:
    """Strings that stand out in toxic texts.

    Candidates are drawn by the number of texts they are in; then the different pairs
    of neighbours they stand between are counted, so that copies of a text count once.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def out() -> pa.RecordBatch:
            rows = [(u, n if toxic else 0, 0 if toxic else n) for toxic, c in seen.items() for u, n in c.items()]
            for c in seen.values():
                c.clear()
            return _batch([[r[i] for r in rows] for i in range(3)], [pa.string(), pa.int64(), pa.int64()], "unit bad good")

        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for piece in pieces(batch, 0):
                for i, _, words in piece:
                    found = {u for w in set(words) for u in units(w)}
                    seen[toxic[i]].update(u for u in found if len(u) <= LANDMARK_CHARS and u[1:-1].isalpha())
                if sum(map(len, seen.values())) > KNOWN_WORDS:
                    yield out()
        yield out()

    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    counts = labelled.mapInArrow(count, "unit string, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    # a string that is in one toxic text only tells nothing of other texts, and neither does one of many clean ones
    top = counts.filter((F.col("bad") > 1) & (odds > ODDS)).orderBy((odds * F.col("bad")).desc(), "unit").limit(CANDIDATES)
    wanted = {r["unit"] for r in top.collect()}

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for piece in pieces(batch, 0):
                found = set()
                for i, _, words in piece:
                    for j, w in enumerate(words):
                        for u in wanted.intersection(units(w)):
                            found.add((u, words[j - 1] if j else "", words[j + 1] if j + 1 < len(words) else "", toxic[i]))
                yield _batch([[f[c] for f in found] for c in range(4)], [pa.string()] * 3 + [pa.bool_()], "unit before after toxic")

    places = labelled.mapInArrow(around, "unit string, before string, after string, toxic boolean").distinct()
    contexts = places.groupBy("unit").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    best = contexts.filter((F.col("bad") > 1) & (odds > ODDS)).orderBy((odds * F.col("bad")).desc(), "unit").limit(LANDMARKS)
    return [r["unit"] for r in best.collect()]


def _sentence_table(labelled: DataFrame, landmarks: Landmarks) -> DataFrame:
    """Features of each different sentence that has any, with the number of its labels; one row without for all others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(landmarks)
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for piece in pieces(batch, 0):
                reader.meet(set().union(*(words for _, _, words in piece)))
                none = [0, 0]
                out = []
                for i, part, _ in piece:
                    some = [(" ".join(s.split()), x, int(toxic[i]), int(not toxic[i])) for s, x in reader.sentences(part)]
                    none[not toxic[i]] += sum(1 for s in SENTENCE_END.split(part) if s) - len(some)
                    out += some
                out.append((None, None, *none))
                yield _batch([[o[c] for o in out] for c in range(4)], [pa.string(), pa.list_(pa.float32()), pa.int64(), pa.int64()], "s x bad good")

    found = labelled.mapInArrow(run, "s string, x array<float>, bad long, good long")
    keyed = found.select(F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2"), "x", "bad", "good")
    return cut_lineage(keyed.groupBy("k1", "k2").agg(F.first("x").alias("x"), F.sum("bad").alias("bad"), F.sum("good").alias("good")))


def _train(table: DataFrame, root: np.ndarray) -> np.ndarray:
    """Weights of the features, and the bias, of the least squared hinge loss."""
    d = len(root) + 1
    w = np.zeros(d)
    for _ in range(STEPS):
        def sums(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            left, right = np.zeros((d, d)), np.zeros(d)
            for batch in batches:
                with_x = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                x = np.zeros((batch.num_rows, d))
                x[:, -1] = 1
                x[with_x, :-1] = batch.column(0).drop_null().flatten().to_numpy().reshape(-1, d - 1) @ root
                bad, good = (batch.column(i).to_numpy().astype(np.float64) for i in (1, 2))
                # a sentence met often counts once, with the shares of its labels; those without features count each
                once = np.where(with_x, 1 / np.maximum(bad + good, 1), 1.0)
                value = x @ w
                for y, n in ((1.0, bad * once), (-1.0, good * once)):
                    open_ = n * (y * value < 1)
                    left += (x * open_[:, None]).T @ x
                    right += y * (x * open_[:, None]).sum(axis=0)
            yield _batch([[np.append(left.ravel(), right)]], [pa.list_(pa.float64())], "sums")

        parts = table.select("x", "bad", "good").mapInArrow(sums, "sums array<double>").select(F.posexplode("sums").alias("at", "value"))
        total = np.zeros(d * d + d)
        for at, value in parts.groupBy("at").agg(F.sum("value")).collect():
            total[at] = value
        keep = np.full(d, RIDGE)
        keep[-1] = 1e-6
        new = np.linalg.solve(total[:d * d].reshape(d, d) + np.diag(keep), total[d * d:])
        if np.abs(new - w).max() < 1e-4:
            return new
        # half a step if the last one went too far to settle
        w = new if _ < STEPS // 2 else (w + new) / 2
    return w


def _judged(docs: DataFrame, landmarks: Landmarks, weights: np.ndarray, bias: float, keep: list[str]) -> DataFrame:
    """For each ``text``, beside the columns to keep: the decision for the worst sentence, the sum of what
    sentences have over the bias, and the number of words."""
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(landmarks)
        for batch in batches:
            worst = np.full(batch.num_rows, bias)
            total, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for piece in pieces(batch, n_keep):
                each = [set(words) for _, _, words in piece]
                reader.meet(set().union(*each))
                for (i, part, words_), own in zip(piece, each):
                    words[i] += len(words_)
                    if reader.hits.keys().isdisjoint(own):
                        continue
                    for _, x in reader.sentences(part):
                        over = float(x @ weights)
                        worst[i] = max(worst[i], bias + over)
                        total[i] += max(over, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *map(pa.array, (worst, total, words))],
                                             names=[*keep, "worst", "total", "words"])

    schema = docs.select(*keep).schema.add("worst", "double").add("total", "double").add("words", "double")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def _figures() -> list[Column]:
    """Worst sentence, all sentences, and their part of the text."""
    return [F.greatest(F.least("worst", F.lit(4.0)), F.lit(-4.0)), F.log1p("total"),
            F.least(F.col("total") * 100 / (F.col("words") + 20), F.lit(10.0)), F.lit(1.0)]


def _curve(a: list[float]) -> Column:
    z = sum((c * float(w) for c, w in zip(_figures(), a)), F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _calibrate(judged: DataFrame) -> list[float]:
    """Weights of the logistic curve of the label, by Newton steps, each one aggregation."""
    figures = _figures()
    n = len(figures)
    a = np.zeros(n)
    for _ in range(25):
        p, y = _curve(a.tolist()), F.col("toxic").cast("double")
        known = judged.select(*(f.alias(f"f{i}") for i, f in enumerate(figures)), (p * (1 - p)).alias("h"), (y - p).alias("g"))
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        row = known.agg(*(F.sum(F.col(f"f{i}") * F.col(f"f{j}") * F.col("h")) for i, j in pairs),
                        *(F.sum(F.col(f"f{i}") * F.col("g")) for i in range(n))).first()
        left = np.eye(n)
        right = np.array(row[len(pairs):]) - a
        for (i, j), v in zip(pairs, row):
            left[i, j] += v
            left[j, i] = left[i, j]
        step = np.clip(np.linalg.solve(left, right), -3, 3)
        a = a + step
        if np.abs(step).max() < 1e-4:
            break
    return a.tolist()


def _sample(labelled: DataFrame) -> DataFrame:
    """About ``LEARNED_ROWS`` of the rows, by a hash of id and text, or all if there are not more."""
    n = labelled.count()
    low = F.xxhash64("id", "text").cast("double") < 2.0**64 * min(1.0, LEARNED_ROWS / max(n, 1)) - 2.0**63
    return (labelled.filter(low) if n > LEARNED_ROWS else labelled).select("text", "toxic")


def score(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, id_column: str = "doc_id",
          text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """``score`` and ``predicted`` of each text, after learning the rows of ``docs`` that ``learn`` is true for.

    Labels are joined by ``id_column``. A label is 0 or 1; rows with a NULL id or label are
    not learned, and of several labels of an id 1 counts. About ``LEARNED_ROWS`` rows are
    learned, drawn by a hash of id and text out of all labelled rows.
    A NULL or empty text, and one without a word of four letters, has no features and gets the
    score of a sentence that resembles no landmark. Without labels of both kinds every
    score is the share of label 1, 0 if there are none. Rows come back once each, also
    those with NULL or repeated ids. Other columns are left out, whatever their names.
    """
    texts = docs.select(named(id_column).alias("id"), named(text_column).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    marked = labels.select(named(id_column).alias("id"), named(label_column).alias("toxic")).filter("id IS NOT NULL AND toxic IS NOT NULL")
    marked = marked.groupBy("id").agg((F.max("toxic") >= 1).alias("toxic"))
    labelled = cut_lineage(_sample(texts.filter("learn").join(marked, "id").select("id", "toxic", "text")))
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    out = [F.col("id").alias(id_column), "score", (F.col("score") >= threshold).cast("int").alias("predicted")]
    if len(sizes) < 2:
        share = sizes.get(True, 0) / max(sum(sizes.values()), 1)
        return texts.withColumn("score", F.lit(float(share))).select(*out)
    landmarks = Landmarks(choose_landmarks(labelled))
    root = landmarks.root() if landmarks.strings else np.zeros((0, 0))
    w = _train(_sentence_table(labelled, landmarks), root)
    weights, bias = root @ w[:-1], float(w[-1])
    curve = _calibrate(cut_lineage(_judged(labelled, landmarks, weights, bias, ["toxic"])))
    return _judged(texts, landmarks, weights, bias, ["id"]).withColumn("score", _curve(curve)).select(*out)
