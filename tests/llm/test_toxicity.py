"""The subsequence kernel against its definition, and what the scorer learns."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascope.llm import toxicity

WORDS = ["s" + a + b + c for a in "aeiou" for b in ("rt", "ll", "nd", "mp") for c in ("en", "ing", "ory", "ath")]


def plain_kernel(s, t):
    def ways(x):
        out = defaultdict(float)
        for places in itertools.combinations(range(len(x)), toxicity.LENGTH):
            letters = tuple(x[p] for p in places)
            if all(c.isalnum() or c in "\x02\x03" for c in letters):
                out[letters] += toxicity.DECAY ** (places[-1] - places[0] + 1)
        return out
    a, b = ways(s), ways(t)
    return sum(v * b[k] for k, v in a.items() if k in b)


def common(s, t):
    table = [[0] * (len(t) + 1)]
    for a in s:
        row = [0]
        for j, b in enumerate(t):
            row.append(table[-1][j] + 1 if a == b and (a.isalnum() or a in "\x02\x03") else max(table[-1][j + 1], row[-1]))
        table.append(row)
    return table[-1][-1]


def test_kernel_and_screen_equal_their_definitions():
    rng = random.Random(2)
    strings = ["\x02" + "".join(rng.choice("abc-d") for _ in range(rng.randrange(4, 11))) + "\x03" for _ in range(120)]
    marks = toxicity.Landmarks(["\x02abcd\x03", "\x02bbcada\x03", "\x02dcbadcba\x03", "\x02aaaa\x03"] + [f"\x02{'abcd' * 3}x{i}\x03" for i in range(6)])
    got = marks.features(strings)
    for i, s in enumerate(strings):
        for j, z in enumerate(marks.strings):
            want = plain_kernel(s, z) / np.sqrt(plain_kernel(s, s) * plain_kernel(z, z)) if common(s, z) >= marks.least[j] else 0.0
            assert got[i, j] == pytest.approx(want, abs=1e-5)


def test_units_of_gapped_and_long_words():
    assert toxicity.units('"Idiot,"') == ["\x02Idiot\x03"] and toxicity.units("$$$") == []
    assert "idiot" in next(toxicity.parts("so i d i o t is")).split()
    long = "x" * 300 + "idiot" + "y" * 300
    assert any("idiot" in u for u in toxicity.units(long)) and all(len(u) <= toxicity.UNIT_CHARS for u in toxicity.units(long))
    marks = toxicity.Landmarks(["\x02idiot\x03"])
    near = marks.features([u for w in ("i-d-i-o-t", "idxiot", "island") for u in toxicity.units(w)])[:, 0]
    assert near[0] > 0.9 and near[1] > 0.4 and near[2] < 0.1


def test_parts_of_a_long_text_end_with_sentences(monkeypatch):
    text = "One two three. Four five six!\nSeven eight nine? " * 50
    monkeypatch.setattr(toxicity, "PART_CHARS", 40)
    cut = list(toxicity.parts(text))
    assert "".join(cut) == text.lower() and len(cut) > 20 and all(c.rstrip()[-1] in ".!?" for c in cut)
    assert list(toxicity.parts(None)) == [] == list(toxicity.parts(""))


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(60)]
        if toxic:
            for _ in range(3):
                bad = rng.choice(["grumblethorp", "snivelwart"])
                at = rng.randrange(1, len(bad) - 1)
                words[rng.randrange(60)] = rng.choice([bad, bad[:at] + "-" + bad[at:], bad[:at] + "q" + bad[at:], ".".join(bad)])
        rows.append((i, " ".join(words).replace("ory s", "ory. S")))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_texts_with_changed_insults_are_found(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, marks, F.col("doc_id") % 3 != 1).collect()
    held = [(r["predicted"], labels[r["doc_id"]][1]) for r in got if r["doc_id"] % 3 == 1]
    assert sum(p == y for p, y in held) > 0.95 * len(held)
    again = toxicity.score(docs, marks.withColumn("toxic", F.when(F.col("doc_id") % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))), F.col("doc_id") % 3 != 1)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))  # labels of rows not to learn change nothing


def test_odd_tables(spark, odd_docs, no_docs):
    rows, labels = corpus(120, 5)
    extra = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 1000)
    names = ["lang", "source", "n_chars"]
    docs = odd_docs.unionByName(extra.withColumns({n: F.lit(None) for n in names}), allowMissingColumns=True).withColumn("toxic", F.lit("x")).withColumn("learn", F.lit(0))
    marks = spark.createDataFrame([(i + 1000, y) for i, y in labels] + [(1, None), (2, 0), (2, 0), (None, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, marks, F.col("doc_id") > 1).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=repr)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (3, 4, 5)}
    assert len(same) == 1
    assert toxicity.score(no_docs, marks, F.lit(True)).collect() == []
    assert {r["score"] for r in toxicity.score(odd_docs, marks.limit(0), F.lit(True)).collect()} == {0.0}
    ones = marks.filter("toxic = 1").unionByName(spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd_docs, ones, F.lit(True)).collect()} == {1.0}
