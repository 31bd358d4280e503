"""Exact removal of repeated byte strings by a sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it starts earlier too.

*Suffixes.* Sorting every suffix would move the text a hundred times, so only
some positions are suffixes of the array: in each string of ``LENGTH`` bytes
the one whose leading ``TOKEN`` bytes have the least fingerprint, the leftmost
of equals. Equal strings choose the same place. A suffix speaks for all
strings that chose it, which start at adjacent places, and its context is the
text that these cover.

*Sort.* Splitters of a sample cut the order of the leading tokens into ranges;
a range is one bucket, sorted locally by multikey quicksort: by the first
eight bytes, ties by a fingerprint of the leading token, ties by a fingerprint
of the context, then by place. In a bucket, a suffix that follows one with its
context repeats it in full. A suffix whose leading token comes with several
contexts may share some of its strings with one of them: those that begin
``SIDE`` bytes before the token or earlier only if the bytes on the left agree
too, the others only if those on the right do. What agrees is left open, and so
is all of a suffix at the edges of a bucket, whose neighbours are in other
buckets.

*Comparison.* The strings of open suffixes are compared one by one, by 128-bit
fingerprints, over all buckets.

Equal suffixes and strings that meet in one slice of a task already leave only
the first there, so a passage that a third of all documents share sends one row
for each slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import named
from deltascope.llm.hashing import BYTE_CODE, mix
from deltascope.functions.ranking import ranged_row_number
from deltascope.session import cut_lineage

LENGTH = 100
TOKEN = 32
CHOICES = LENGTH - TOKEN + 1
#: A string that begins SIDE bytes before the token or earlier has all of these bytes; any other has as many after it.
SIDE = CHOICES // 2
#: Bytes of text handled together in a task, and bits for a place in them.
SLICE_BYTES = 1 << 21
PLACE_BITS = np.uint64(22)
#: Bytes of text whose suffixes make one bucket, about, and documents sampled for the splitters.
BUCKET_BYTES = 24 << 20
SAMPLE_DOCS = 2000
#: Groups of ids by which documents without any repeat are told apart; a fixed number, so their list may be sent to all tasks.
ID_GROUPS = 1 << 17

PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
ROW = "bucket int, t1 long, t2 int, context long, left int, right int, doc long, start int, more int, place int"


def _inverse(p: np.uint64) -> np.uint64:
    return np.uint64(pow(int(p), -1, 1 << 64))


class Prefixes:
    """Fingerprints of any substring of a slice: sums of byte codes times powers, modulo 2**64."""

    def __init__(self, data: np.ndarray, family: int):
        n = len(data)
        powers = np.full(n, PRIMES[family], dtype=np.uint64)
        backs = np.full(n + 1, _inverse(PRIMES[family]), dtype=np.uint64)
        if n:
            powers[0] = 1
        backs[0] = 1
        self.back = np.multiply.accumulate(backs)
        code = BYTE_CODE if family == 0 else mix(BYTE_CODE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code[data] * np.multiply.accumulate(powers), dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by several keys: sort by the first, then only the runs of ties by the next, and so on."""
    order = np.argsort(keys[0], kind="stable")
    for depth in range(1, len(keys)):
        tied = np.ones(len(order) - 1 if len(order) else 0, dtype=bool)
        for k in keys[:depth]:
            ranked = k[order]
            tied &= ranked[1:] == ranked[:-1]
        if not tied.any():
            break
        run = np.concatenate([[0], np.cumsum(~tied)])
        inside = np.concatenate([tied, [False]]) | np.concatenate([[False], tied])
        at = np.flatnonzero(inside)
        order[at] = order[at][np.lexsort((keys[depth][order[at]], run[at]))]
    return order


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans joined where they touch or overlap within a document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]).astype(np.int64)
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    opens = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], reach[last]


def suffixes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, start, more, t1, t2, context, left, right, place) of the chosen suffixes of a slice.

    A suffix speaks for the strings at ``start`` to ``start + more``, counted
    from the text's first byte, and begins ``place`` bytes after ``start``.
    ``left`` and ``right`` are fingerprints of its token with ``SIDE`` bytes
    before or after it.
    """
    n = len(data)
    empty = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return (empty,) * 9
    one = Prefixes(data, 0)
    at = np.arange(n - TOKEN + 1)
    leading = one.of(at, at + TOKEN)
    least = (leading & ~np.uint64((1 << int(PLACE_BITS)) - 1)) | at.astype(np.uint64)
    low, width = least, 1
    while width * 2 <= CHOICES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = CHOICES - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    chosen = (low & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    sizes = np.diff(bounds)
    fits = np.zeros(n + 1, dtype=np.int8)  # starts of strings inside one text
    long_ = sizes >= LENGTH
    np.add.at(fits, bounds[:-1][long_], 1)
    np.add.at(fits, bounds[:-1][long_] + sizes[long_] - LENGTH + 1, -1)
    inside = np.cumsum(fits)[:len(chosen)] > 0
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | ~inside[:-1]])
    first = np.flatnonzero(inside & new)
    if not len(first):
        return (empty,) * 9
    stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    token = chosen[first]
    t1 = np.zeros(len(token), dtype=np.uint64)
    for i in range(8):
        t1 = (t1 << np.uint64(8)) | data[token + i].astype(np.uint64)
    two = Prefixes(data, 1)
    context = mix(two.of(first, stop + LENGTH) ^ ((token - first).astype(np.uint64) << np.uint64(40)))
    owner = np.searchsorted(bounds, first, side="right") - 1
    left = one.of(np.maximum(token - SIDE, bounds[owner]), token + TOKEN) >> np.uint64(32)
    right = one.of(token, np.minimum(token + TOKEN + SIDE, bounds[owner + 1])) >> np.uint64(32)
    return owner, first - bounds[owner], stop - first, t1, leading[token] >> np.uint64(32), context, left, right, token - first


def _slices(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, bounds) of pieces of a batch; texts longer than a piece are pieces of their own."""
    raws, size, first = [], 0, 0
    for i, t in enumerate(batch.column(text_at)):
        raw = (t.as_py() or "").encode()
        if raws and size + len(raw) > SLICE_BYTES:
            yield first, i, np.frombuffer(b"".join(raws), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])])
            raws, size, first = [], 0, i
        raws.append(raw)
        size += len(raw)
    if raws:
        yield first, batch.num_rows, np.frombuffer(b"".join(raws), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])])


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Suffixes of a slice; a text beyond the place bits is cut into overlapping parts, at content-blind places.

    A string near a cut is in one part, whole; which suffix speaks for it
    depends on the string alone.
    """
    most = 1 << int(PLACE_BITS)
    if len(data) <= most:
        yield suffixes(data, bounds)
        return
    step = most - LENGTH + 1
    for a in range(0, len(data), step):
        part = data[a:a + most]
        owner, start, *more = suffixes(part, np.array([0, len(part)]))
        yield owner, start + a, *more


def _columns(bucket, t1, t2, context, left, right, doc, start, more, place) -> pa.RecordBatch:
    def long_(x):
        return pa.array(np.asarray(x).astype(np.uint64).view(np.int64))

    def int_(x):
        return pa.array(np.asarray(x).astype(np.int64).astype(np.uint32).view(np.int32))

    return pa.RecordBatch.from_arrays(
        [int_(bucket), long_(t1), int_(t2), long_(context), int_(left), int_(right), pa.array(doc), int_(start), int_(more), int_(place)],
        names=[c.split()[0] for c in ROW.split(", ")])


def _repeats(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether equal in all keys to the row before, whether that group began at an earlier place)."""
    order = multikey_order([*keys, doc, start])
    equal = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in keys:
        ranked = k[order]
        equal &= ranked[1:] == ranked[:-1]
    equal = np.concatenate([[False], equal]) if len(order) else equal
    head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(order)))) if len(order) else np.zeros(0, dtype=np.int64)
    later = equal & ((doc[order] != doc[order][head]) | (start[order] != start[order][head]))
    return order, equal, later


def leading_order(t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Order of the leading tokens: five bytes, then the token's fingerprint."""
    return (t1.astype(np.uint64) & ~np.uint64((1 << 24) - 1)) | (t2.astype(np.uint64) >> np.uint64(8))


def _send(splitters: np.ndarray):
    """Suffixes of the documents with their buckets; repeats within a slice go on as spans (``more`` = -length)."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, bounds in _slices(batch, 1):
                parts = list(_pieces(data, bounds))
                owner, start, more, t1, t2, context, left, right, place = (np.concatenate(x) for x in zip(*parts))
                doc = docs[a:b][owner]
                order, equal, later = _repeats([t1, t2, context], doc, start)
                gone = order[later]
                spans = merged(doc[gone], start[gone], start[gone] + more[gone] + LENGTH)
                keep = order[~equal]
                bucket = np.searchsorted(splitters, leading_order(t1[keep], t2[keep]), side="right")
                if len(keep):
                    yield _columns(bucket, t1[keep], t2[keep], context[keep], left[keep], right[keep], doc[keep], start[keep],
                                   more[keep], place[keep])
                if len(spans[0]):
                    zero = np.zeros(len(spans[0]), dtype=np.int64)
                    yield _columns(spans[0] % (len(splitters) + 1), zero, zero, zero, zero, zero, spans[0], spans[1],
                                   spans[1] - spans[2], zero)
    return send


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: spans (kind 0) and strings left open (kind 1, from start to end) as (kind, doc, start, end)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    cols = {name: table.column(name).to_numpy() for name in table.column_names}
    passed = cols["more"] < 0
    spans = [(cols["doc"][passed], cols["start"][passed].astype(np.int64), cols["start"][passed].astype(np.int64) - cols["more"][passed])]
    live = ~passed
    t1, context = (np.ascontiguousarray(cols[c][live]).view(np.uint64) for c in ("t1", "context"))
    t2, left, right = (cols[c][live] for c in ("t2", "left", "right"))
    doc = cols["doc"][live]
    start, more, place = (cols[c][live].astype(np.int64) for c in ("start", "more", "place"))
    order, equal, later = _repeats([t1, t2, context], doc, start)
    gone = order[later]
    spans.append((doc[gone], start[gone], start[gone] + more[gone] + LENGTH))
    lead = order[~equal]
    if len(lead):
        same = (t1[lead][1:] == t1[lead][:-1]) & (t2[lead][1:] == t2[lead][:-1])
        crowd = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        edge = np.zeros(len(lead), dtype=bool)
        for x in (lead[0], lead[-1]):
            edge |= (t1[lead] == t1[x]) & (t2[lead] == t2[x])
        lead, edge = lead[crowd | edge], edge[crowd | edge]
    else:
        edge = np.zeros(0, dtype=bool)

    def agrees(side: np.ndarray) -> np.ndarray:
        """Whether another suffix of the token has these bytes on that side."""
        keys = [t1[lead], t2[lead], side[lead]]
        at = multikey_order(keys)
        same = np.ones(max(0, len(at) - 1), dtype=bool)
        for k in keys:
            same &= k[at][1:] == k[at][:-1]
        out = np.zeros(len(at), dtype=bool)
        out[at[1:][same]] = True
        out[at[:-1][same]] = True
        return out | edge

    border = start[lead] + place[lead] - SIDE  # the last string with all bytes on the left
    first, last = start[lead], start[lead] + more[lead]
    by_left, by_right = agrees(left), agrees(right)
    begin = np.where(by_left, first, np.maximum(first, border + 1))
    end = np.where(by_right, last, np.minimum(last, border))
    some = (by_left | by_right) & (begin <= end)
    found = merged(*(np.concatenate(x) for x in zip(*spans)))
    for kind, (d, s, e) in ((0, found), (1, (doc[lead][some], begin[some], end[some]))):
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), kind, dtype=np.int32)), pa.array(d), pa.array(s.astype(np.int32)),
                                              pa.array(e.astype(np.int32))], names=["kind", "doc", "start", "end"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the strings of open suffixes; equal ones within a slice go on as spans (``end`` > 0)."""
    kinds = ["w1", "w2", "doc", "start", "end"]
    for batch in batches:
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, bounds in _slices(batch, 1):
            firsts, counts, owner = [], [], []
            for i in range(a, b):
                for o in batch.column(2)[i].as_py():
                    firsts.append(o["start"] + bounds[i - a])
                    counts.append(o["end"] - o["start"] + 1)
                    owner.append(i - a)
            firsts, counts, owner = (np.array(x, dtype=np.int64) for x in (firsts, counts, owner))
            at = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            text = np.repeat(owner, counts)
            fits = at + LENGTH <= bounds[text + 1]
            at, text = at[fits], text[fits]
            w1, w2 = Prefixes(data, 0).of(at, at + LENGTH), Prefixes(data, 1).of(at, at + LENGTH)
            doc, start = docs[a:b][text], at - bounds[text]
            order, equal, later = _repeats([w1, w2], doc, start)
            gone, keep = order[later], order[~equal]
            spans = merged(doc[gone], start[gone], start[gone] + LENGTH)
            for d, s, e, x, y in ((doc[keep], start[keep], np.zeros(len(keep), dtype=np.int64), w1[keep], w2[keep]),
                                  (*spans, spans[0].view(np.uint64), spans[0].view(np.uint64))):
                if len(d):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(d), pa.array(s.astype(np.int32)),
                         pa.array(e.astype(np.int32))], names=kinds)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the strings that follow an equal one, from rows sorted by (w1, w2, doc, start)."""
    last: tuple | None = None
    for batch in batches:
        w1, w2, doc, start, end = (batch.column(i).to_numpy() for i in range(5))
        passed = end > 0
        if passed.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[passed]), pa.array(start[passed]), pa.array(end[passed])], names=["doc", "start", "end"])
        w1, w2, doc, start = w1[~passed], w2[~passed], doc[~passed], start[~passed].astype(np.int64)
        if not len(w1):
            continue
        if last is not None:
            w1, w2, doc, start = (np.concatenate([[x], y]) for x, y in zip(last, (w1, w2, doc, start)))
        equal = np.concatenate([[False], (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])])
        head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(w1))))
        later = equal & ((doc != doc[head]) | (start != start[head]))
        h = head[-1]
        last = (w1[h], w2[h], doc[h], start[h])
        d, s, e = merged(doc[later], start[later], start[later] + LENGTH)
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc", "start", "end"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document: its spans are joined and cut out."""
    for batch in batches:
        rows = []
        for doc, text, spans in zip(*(batch.column(i) for i in range(3))):
            raw, runs = (text.as_py() or "").encode(), []
            for s in sorted(spans.as_py() or [], key=lambda s: s["start"]):
                end = min(s["end"], len(raw))
                if runs and s["start"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                elif s["start"] < end:
                    runs.append([s["start"], end])
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rows.append((doc.as_py(), len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest(),
                         [{"start": a, "end": b} for a, b in runs]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                         names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def splitters_of(docs: DataFrame, buckets: int) -> np.ndarray:
    """Borders of the buckets in the order of leading tokens, from the suffixes of a sample of documents."""
    if buckets < 2:
        return np.zeros(0, dtype=np.uint64)
    step = max(1, docs.count() // SAMPLE_DOCS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in _slices(batch, 1):
                for _, _, _, t1, t2, *_ in _pieces(data, bounds):
                    place = leading_order(t1, t2)
                    yield pa.RecordBatch.from_arrays([pa.array((place ^ np.uint64(1 << 63)).view(np.int64))], names=["place"])

    sample = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(step)) == 0).mapInArrow(places, "place long")
    cut = sample.agg(F.percentile_approx("place", [i / buckets for i in range(1, buckets)], 20000)).first()[0]
    return np.unique(np.array(cut or [], dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63))


def remove_repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (start and end of each run, in bytes) of each document.

    Texts are UTF-8 bytes, a NULL text none. Strings are judged on the input,
    not on what is left of it; the earlier start is that of the smaller id, or
    the earlier place in one document; a NULL id ranks last. Rows equal in id
    and text don't remove each other and get equal results; texts that share an
    id, or have none, are documents of their own, in the order of two hashes of
    the text. Other columns are left out.
    """
    last = F.lit(2**63 - 1)
    own = docs.select(F.coalesce(named(id_column).cast("long"), last).alias("doc"), named(text_column).alias("text"))
    shared = own.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    if shared.isEmpty():
        return _removal(own).withColumn("doc_id", F.when(F.col("doc") < last, F.col("doc"))).select("doc_id", *RESULT)
    known = own.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    numbers = cut_lineage(ranged_row_number(known.select("doc", "t1", "t2").distinct(), ["doc", "t1", "t2"], "number"))
    placed = known.join(numbers, ["doc", "t1", "t2"]).select(F.col("number").alias("doc"), "text")
    back = numbers.select(F.col("number").alias("doc"), F.when(F.col("doc") < last, F.col("doc")).alias("doc_id"))
    return _removal(cut_lineage(placed)).join(back, "doc").select("doc_id", *RESULT)


#: Columns of the result beside the id.
RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")


def _removal(own: DataFrame) -> DataFrame:
    """``doc`` and what is removed; ``doc`` names one text each."""
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splitters = splitters_of(own, max(parts, -(-total // BUCKET_BYTES)))
    sent = own.mapInArrow(_send(splitters), ROW)
    dealt = sent.repartitionById(len(splitters) + 1, F.col("bucket"))
    sorted_ = cut_lineage(dealt.mapInArrow(_sort, "kind int, doc long, start int, end int"))

    def group(doc):
        return F.pmod(F.xxhash64(doc), F.lit(ID_GROUPS)).cast("int")

    opens = sorted_.filter("kind = 1").groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("opens"))
    opens = cut_lineage(opens)
    listed = F.broadcast(opens.select(group("doc").alias("_group")).distinct())
    likely = own.withColumn("_group", group("doc")).join(listed, "_group", "left_semi").select("doc", "text")
    strings = likely.join(opens, "doc").select("doc", "text", "opens").mapInArrow(_strings, "w1 long, w2 long, doc long, start int, end int")
    dealt = strings.repartition("w1").sortWithinPartitions("w1", "w2", "doc", "start")
    matched = dealt.mapInArrow(_match, "doc long, start int, end int")
    spans = cut_lineage(sorted_.filter("kind = 0").select("doc", "start", "end").unionByName(matched)
                        .groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")))

    groups = F.broadcast(spans.select(group("doc").alias("_group"), F.lit(True).alias("_met")).distinct())
    marked = own.withColumn("_group", group("doc")).join(groups, "_group", "left")
    touched = (marked.filter("_met").select("doc", "text").join(spans, "doc", "left").select("doc", "text", "spans")
               .mapInArrow(_digest, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                    "removed array<struct<start:int,end:int>>"))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    whole = marked.filter("_met IS NULL").select(
        "doc", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"),
        F.array().cast("array<struct<start:int,end:int>>").alias("removed"))
    return touched.unionByName(whole)
