"""Token ids as length-delimited binary records with a separate offset index.

A record is, little-endian,

    u64 length | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload | newline

and its payload i64 document id | u8 flags | token ids, as u16, or as u32 if
flag 2 is set. Flag 1 marks a NULL id. A checksum c is masked as
``((c >> 15 | c << 17) + 0xa282ead8) mod 2**32``. Lengths, not newlines, end a
record; the newline is what Spark's text writer puts after each row, which
lets Spark write the files on any of its file systems, with its commit rules.
Files hold ascending ids; a file's number is in its name.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltascope.llm.common import join_small, named
from deltascope.session import work_dir

END_ID = 2
MASK_DELTA = 0xA282EAD8  # fixed value of the record format
HEAD, TAIL = 12, 5
#: Pieces whose ids a Python worker remembers; the store is emptied when full.
CACHE_PIECES = 700_000
#: What \s+ of the normalizer doesn't take but str.split does, and the start of special tokens.
ODD = re.compile(r"[\x1c-\x1f]|<\|")
#: A piece that lower-cases the same way everywhere: Latin letters, then full stops and commas.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
MARKS = re.compile(r"[.,!?;:]+")


def masked(checksum: int) -> int:
    return (((checksum >> 15) | (checksum << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(zlib.crc32(length))), payload,
                     struct.pack("<I", masked(zlib.crc32(payload)))))


class Words(dict):
    """Numbers of pieces in the order in which they were first looked up; ``new`` lists those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Texts to ids with a tokenizers file, word for word the same as encoding the whole text.

    White space ends a word for this kind of tokenizer (``end_of_word_suffix``)
    and gives no token, so a text is the sequence of its white-space-separated
    pieces. Pieces met for the first time are encoded together and their ids
    remembered, in one array in which a piece has a place; a text with characters
    on which the two notions of white space differ, or with a special token's
    opening, is encoded whole, and so is every text for another kind of tokenizer.
    """

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for lower-case Latin words and marks, blanks between them: the normalizer has nothing to do, a blank cuts
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "Straße, ÀÉ?! no."
        self.cuts = (getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>" and
                     self.tokenizer.encode(probe, add_special_tokens=False).ids
                     == self.plain.encode("straße , àé ?! no .", add_special_tokens=False).ids)
        self.wide = self.tokenizer.get_vocab_size() > 65536
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.limit = cache
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        """Drop all pieces met so far."""
        self.known = Words()
        self.ids = np.empty(1 << 12, dtype=self.kind)  # of all pieces; ``used`` of them
        self.used = 0
        self.spans = np.empty((1 << 10, 2), dtype=np.int64)  # start and length of each piece's ids

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def store(self, ids: np.ndarray) -> int:
        """Place of the first of these ids, put after all others."""
        start, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.concatenate([self.ids[:start], np.empty(max(self.used, start // 2), dtype=self.kind)])
        self.ids[start:self.used] = ids
        return start

    def gather(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these spans, one after the other, and where each ends among them."""
        starts, sizes = spans.T
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)], ends

    def learn(self) -> None:
        """Encode words not met before: plain ones a few hundred at a time, the others one by one."""
        known = self.known
        first = len(known) - len(known.new)
        plain: list[int] = []  # places in the list of new pieces
        odd: list[int] = []
        split: list[tuple[int, int, int]] = []
        none = known[""]
        for k, p in enumerate(known.new):  # grows by the parts that are new themselves
            m = PLAIN.fullmatch(p)
            if m is None:
                (plain if MARKS.fullmatch(p) else odd).append(k)
            elif (word := m[1].lower()) == p:
                plain.append(k)
            else:
                split.append((first + k, known[word], known[m[2]]))
        new, known.new = known.new, []
        if len(known) > len(self.spans):
            self.spans = np.concatenate([self.spans, np.empty((len(known) - len(self.spans) // 2, 2), dtype=np.int64)])
        spans = self.spans
        for i in range(0, len(plain), 500):
            some = plain[i:i + 500]
            ids = np.array(self.plain.encode_batch_fast([" ".join([new[k] for k in some])], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                at, starts = np.array(some) + first, np.concatenate([[0], ends[:-1]])
                spans[at, 0], spans[at, 1] = starts + self.store(ids), ends - starts
            else:  # a part that the tokenizer cuts further
                odd += some
        for k in odd:
            ids = self.whole(new[k])
            spans[first + k] = self.store(ids), len(ids)
        numbers, words, tails = np.array(split, dtype=np.int64).reshape(-1, 3).T
        bare = tails == none
        spans[numbers[bare]] = spans[words[bare]]
        numbers, words, tails = numbers[~bare], words[~bare], tails[~bare]
        ids, ends = self.gather(spans[np.stack([words, tails], axis=1).ravel()])
        ends = ends[1::2]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[:len(ends)]
        spans[numbers, 0], spans[numbers, 1] = starts + self.store(ids), ends - starts

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > self.limit:
            self.forget()
        cut = [t.split() if self.cuts and not ODD.search(t) else None for t in texts]
        counts = [len(words or ()) for words in cut]
        pieces = itertools.chain.from_iterable(words for words in cut if words)
        numbers = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=sum(counts))
        if self.known.new:
            self.learn()
        ids, ends = self.gather(self.spans[numbers])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)].tolist()
        for text, words, a, b in zip(texts, cut, bounds, bounds[1:]):
            yield (self.whole(text) if words is None else ids[int(a):int(b)]).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Characters encoded together.
SLICE_CHARS = 1_000_000


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts, chars = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1)):
        text = t.as_py() or ""
        ids.append(i.as_py())
        texts.append(text)
        chars += len(text)
        if chars > SLICE_CHARS:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def write_records(docs: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
                  end_id: int = END_ID, keep_words: bool = True) -> str:
    """Write the documents' token ids, in ascending order of their ids, NULL ids first.

    A NULL text is an empty one; every document ends with ``end_id``. Repeated
    rows are records of their own, next to each other. Rows with one id are
    dealt by a further number, so they may span files. Other columns are left out.
    ``keep_words`` false: a task forgets the words it met when it ends, else they stay
    in the Python worker, beside what its next tasks need.
    """
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([end_id], dtype=own.kind).tobytes()
        for batch in batches:
            for ids, texts in _slices(batch):
                out = [frame(struct.pack("<qB", 0 if i is None else i, (i is None) | 2 * own.wide) + body + end)
                       for i, body in zip(ids, own.encode(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
        if not keep_words:
            own.forget()

    rows = docs.select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text"))
    rows = rows.withColumn("own", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "own").sortWithinPartitions("doc_id", "own").select("doc_id", "text")
    framed = ordered.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    framed.write.mode("error").option("lineSep", "\n").text(path)
    return path


def records(content: bytes) -> Iterator[tuple[int, int]]:
    """(offset, payload length) of each record; the lengths' checksums are verified."""
    at = 0
    while at < len(content):
        length, check = struct.unpack_from("<QI", content, at)
        if check != masked(zlib.crc32(content[at:at + 8])):
            raise ValueError(f"damaged record length at byte {at}")
        yield at, length
        at += HEAD + length + TAIL


def read_record(content: bytes, at: int) -> tuple[int | None, np.ndarray]:
    """(document id, token ids) of the record at an offset; all checksums are verified."""
    length, check = struct.unpack_from("<QI", content, at)
    if check != masked(zlib.crc32(content[at:at + 8])):
        raise ValueError(f"damaged record length at byte {at}")
    payload = content[at + HEAD:at + HEAD + length]
    if struct.unpack_from("<I", content, at + HEAD + length)[0] != masked(zlib.crc32(payload)):
        raise ValueError(f"damaged record at byte {at}")
    doc, flags = struct.unpack_from("<qB", payload)
    return (None if flags & 1 else doc), np.frombuffer(payload, dtype="<u4" if flags & 2 else "<u2", offset=9)


def _files(spark: SparkSession, path: str) -> DataFrame:
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select(number.alias("file"), "content"))


def write_index(spark: SparkSession, path: str, index: str) -> str:
    """Scan the files once and write (file, first_record, first_token, offsets), a row for each file.

    ``first_record`` and ``first_token`` count what the files before have.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0), batch.column(1)):
                content = blob.as_py()
                tokens, offsets = 0, []
                for at, length in records(content):
                    offsets.append(at)
                    tokens += (length - 9) // (4 if content[at + HEAD + 8] & 2 else 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()]), pa.array([tokens], pa.int64()), pa.array([offsets], pa.list_(pa.int64()))],
                    names=["file", "tokens", "offsets"])

    sizes = _files(spark, path).mapInArrow(scan, "file long, tokens long, offsets array<long>")
    sizes.write.mode("error").parquet(index + "-sizes")
    sizes = spark.read.parquet(index + "-sizes")
    # one narrow row for each file: the running sum may run in one task
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "tokens", F.size("offsets").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_record"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first_token"))
    sizes.select("file", "offsets").join(starts, "file").write.mode("error").parquet(index)
    return index


def read_digests(spark: SparkSession, path: str, index: str) -> DataFrame:
    """doc_id, record, start, n_tokens, ids_crc32 of each record, read from the files; the index gives what is before a file."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, first, start in zip(*(batch.column(i) for i in range(3))):
                content, record, at = blob.as_py(), first.as_py(), start.as_py()
                rows = []
                for offset, _ in records(content):
                    doc, ids = read_record(content, offset)
                    rows.append((doc, record, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    record, at = record + 1, at + len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5,
                    names=["doc_id", "record", "start", "n_tokens", "ids_crc32"])

    firsts = spark.read.parquet(index).select("file", "first_record", "first_token")
    both = join_small(_files(spark, path), firsts, ["file"]).select("content", "first_record", "first_token")
    return both.mapInArrow(digest, "doc_id long, record long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(spark: SparkSession, path: str, index: str, seed: int = 5, epoch: int = 0) -> DataFrame:
    """doc_id, ids, draw of all records, globally in the order of a random ``draw``.

    The offset index is shuffled, one narrow row for each record; a file is
    then opened once in each task that needs it.
    """
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, offsets, draws in zip(*(batch.column(i) for i in range(3))):
                content = blob.as_py()
                for offset, draw in zip(offsets.as_py(), draws.as_py()):
                    doc, ids = read_record(content, offset)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([draw], pa.int64())],
                        names=["doc_id", "ids", "draw"])

    entries = spark.read.parquet(index).select("file", F.posexplode("offsets").alias("pos", "offset"))
    drawn = entries.withColumn("draw", F.xxhash64(F.lit(seed), F.lit(epoch), "file", "pos"))
    by_file = drawn.groupBy("file").agg(F.collect_list("offset").alias("offsets"), F.collect_list("draw").alias("draws"))
    both = _files(spark, path).join(by_file, "file").select("content", "offsets", "draws")
    return both.mapInArrow(fetch, "doc_id long, ids array<long>, draw long").orderBy("draw")


def export(docs: DataFrame, tokenizer: str, path: str | None = None, id_column: str = "doc_id",
           text_column: str = "text", keep_words: bool = True) -> DataFrame:
    """Write records and index, under the shared folder if no path is given, and read their digests back."""
    spark = docs.sparkSession
    path = path or work_dir(spark, "records")
    write_records(docs, path, tokenizer, id_column, text_column, keep_words=keep_words)
    write_index(spark, path, path + "-index")
    return read_digests(spark, path, path + "-index")
