"""Each operator against a plain version, and on odd and empty tables."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import difference, open_views
from deltascope.llm import chat, common, decontaminate, hashing, langid, mixing, omh, quality, records, sharding, substring, suffix
from deltascope.llm.queries import LLM_ORACLES, LLM_QUERIES, tokenizer_path

from .conftest import LONG, PLAIN


def docs_of(spark, sf):
    return common.table(spark, sf, "documents")


@pytest.mark.parametrize("name", list(LLM_ORACLES))
def test_query_equals_sql(spark, sf, name, monkeypatch):
    import check
    monkeypatch.setattr(check, "queries", lambda: LLM_QUERIES)
    monkeypatch.setattr(check, "oracle_sql", lambda: LLM_ORACLES)
    wrong, n = difference(spark, open_views(sf), sf, name)
    assert wrong is None and n > 0, wrong


@pytest.mark.parametrize("run", [
    substring.remove_repeats, quality.measure_quality, sharding.shuffle_to_shards, mixing.mix_report, langid.identify,
    omh.near_duplicates, lambda d: records.export(d, tokenizer_path()), suffix.remove_repeated_bytes])
def test_odd_and_empty_tables(odd_docs, no_docs, run):
    rows = run(odd_docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.select("doc_id").collect())
    assert run(no_docs).collect() == []


@pytest.mark.parametrize("keep", [quality.keep_good, omh.first_of_classes, mixing.mix])
def test_filters_keep_all_columns(odd_docs, no_docs, keep):
    kept = keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} <= set(range(11)) | {None}
    assert keep(no_docs).collect() == []


# 1 line hashing

def test_passage_inside_other_text_goes_once(spark):
    passage = "Here begins the shared passage of some words. It has a second sentence too."
    rows = [(1, "First text says this. " + passage + " And ends."), (2, "other words " + passage + " more."), (3, "A unique one.")]
    out = {r["doc_id"]: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[0][1] and out[3]["text"] == rows[2][1]
    assert passage not in out[2]["text"] and out[2]["text"].startswith("other words")
    cut = out[2]["removed"][0]
    assert rows[1][1][cut["start"]:cut["start"] + cut["length"]].strip() == passage


def test_units_give_back_the_text():
    for text in (LONG[:500], "iPhone USA x.y!\n\n?É", ""):
        assert "".join(substring.unit_pattern().findall(text)) == text


def test_line_hashing_odd(odd_docs):
    out = {}
    for r in substring.remove_repeats(odd_docs).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert out[3][0]["text"] is None and out[4][0]["text"] == ""
    assert all(r["removed_chars"] == 0 for r in out[1])  # rows of one id don't remove each other's units
    assert out[2][0]["text"] == ""


def test_short_and_unspaced_repeats_go(spark):
    sentence = "这是一个重复出现的很长的句子。"
    rows = [(1, "Main menu\nFirst own text\n开头" + "。" + sentence + "\nHe said yes. Ends here"),
            (2, "Other own text\n - Main  menu\nMain  menu\n另外。" + sentence + "其他\nHe said yes. Then more\n总是重复的行"), (3, "New\n总是重复的行\n")]
    out = {r["doc_id"]: r for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[0][1]
    assert out[2]["text"] == "Other own text\n - Main  menu\n另外。其他\nHe said yes. Then more\n总是重复的行"
    assert out[3]["text"] == "New\n" and out[3]["removed_units"] == 1


def plain_pieces(text):
    """Units and lines as the operator's docstring has them, one at a time: ordinal, words, start, length, whether a line, normalised text."""
    at, out = 0, []
    for unit in substring.unit_pattern().findall(text):
        words = unit.lower().split()
        if words:
            n = len(words) + len(substring.UNSPACED.findall("".join(words))) // 2
            out.append((len(out), n, at, len(unit), False, " ".join(words)))
        at += len(unit)
    at, n = 0, 0
    for line in text.split("\n"):
        if line.split():
            n += 1
            out.append((-n, 0, at, len(line), True, " ".join(line.split())))
        at += len(line) + 1
    return out


def test_only_first_pieces_of_a_text_are_sent():
    import pyarrow as pa
    texts = ["One two. One two. Three four.\nOne two.\nOne two.\n", None, "", "One two."]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 10]), pa.array([1, 2, 3, 4]), pa.array(texts)], names=["row_id", "doc_id", "text"])
    sent = [r for b in substring._unit_rows(iter([batch])) for r in b.to_pylist()]
    assert all(set(r) == {"row_id", "doc_id", "ordinal", "h1", "h2"} for r in sent)
    # of the first text: two units, and two lines
    assert [(r["doc_id"], r["ordinal"]) for r in sent if r["doc_id"] == 1] == [(1, 0), (1, 2), (1, -1), (1, -2)]
    assert len({(r["row_id"], r["h1"], r["h2"]) for r in sent}) == len(sent)


def test_pieces_of_many_texts_at_once_equal_plain_ones():
    rng = np.random.default_rng(12)
    signs = list("abAB ..!\n\t\u3000。é") + ["\u0130", "i\u0307", "Σ", "ς", "σ", "ǅ", "ǆ", "这", "行", "\x85", "\U0001f600", "\U00020001", "\ud7ff", "I", "i"]
    texts = ["", "a", "A b. a  B\nA b.", "\n\n", "...a", "x" * 3000 + " " + "y" * 300, "ab c", "a bc", ""]
    texts += ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(1500)]
    want = [(i, *p) for i, t in enumerate(texts) for p in plain_pieces(t)]
    text, ordinal, words, start, length, h1, h2 = (c.tolist() for c in substring._pieces(texts))
    found = {(i, o): (w, s, n, (x, y)) for i, o, w, s, n, x, y in zip(text, ordinal, words, start, length, h1, h2)}
    assert len(found) == len(text) == len(want)
    digest_of, of_digest = {}, {}
    for i, o, w, s, n, is_line, plain in want:
        assert found[i, o][:3] == (w, s, n)
        assert digest_of.setdefault((is_line, plain), found[i, o][3]) == found[i, o][3]
        assert of_digest.setdefault(found[i, o][3], (is_line, plain)) == (is_line, plain)


# 2 quality rules

def test_cascade_order_changes_no_verdict(spark, sf):
    docs = docs_of(spark, sf)
    rules = quality.default_rules(F.col("text"))
    names = [r.name for r in rules]
    order = quality.plan_cascade(docs, rules)
    assert sorted(order) == sorted(names)
    a = docs.filter(quality.cascade(rules, order)).select("doc_id").collect()
    b = docs.filter(quality.cascade(rules, names[::-1])).select("doc_id").collect()
    assert sorted(a) == sorted(b) == sorted(quality.measure_quality(docs).filter("kept").select("doc_id").collect())


def test_quality_of_odd_rows(odd_docs):
    out = {r["doc_id"]: r for r in quality.measure_quality(odd_docs).collect()}
    assert out[3]["n_words"] == 0 and out[3]["base_failed"] and not out[3]["kept"]
    assert out[2]["kept"] and out[2]["n_words"] == 80
    assert out[6]["n_repeat_words"] == out[6]["n_words"] == 32000 and not out[6]["kept"]


# 3 sharding

def test_matrix_has_the_given_sums():
    blocks, shards = [5, 0, 17, 3], sharding.shard_sizes(25, 4)
    m = sharding.communication_matrix(blocks, shards, 1)
    assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == shards and (m >= 0).all()


def test_hypergeometric_follows_its_distribution():
    rng = np.random.default_rng(5)
    good, bad, drawn = 7, 9, 6
    seen = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(20000))
    for k in range(0, 7):
        p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
        assert abs(seen[k] / 20000 - p) < 0.015
    big = [sharding.hypergeometric(rng, 10**11, 10**11, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 5 * 10**5) < 600


def test_shards(spark, sf):
    docs = docs_of(spark, sf)
    rows = sharding.shuffle_to_shards(docs, block_rows=30).collect()
    again = sharding.shuffle_to_shards(docs, block_rows=30).collect()
    assert sorted(rows) == sorted(again)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)


# 4 decontamination

def plain_leaks(docs, items):
    words = {i: hashing.word_hashes([t])[0] for i, t in items}
    n, mean = len(items), np.mean([len(w) for w in words.values()])
    df = Counter(x for w in words.values() for x in set(w.tolist()))
    window = max(decontaminate.LEAST_WINDOW, 2 * max(map(len, words.values())))

    def score(query, w):
        total = 0.0
        for t, tf in Counter(w.tolist()).items():
            if t in query:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        return total

    found = {}
    for doc, text in docs:
        h = hashing.word_hashes([text or ""])[0]
        starts = range(0, max(1, len(h) - window + window // 2), window // 2) if len(h) else []
        for a in starts:
            part = h[a:a + window]
            query = set(part.tolist())
            for i, text_i in items:
                s = score(query, words[i]) / score(set(words[i].tolist()), words[i])
                q, r = (decontaminate.overlap(hashing.word_hashes([x])[0], part) for x in decontaminate.question_and_answer(text_i))
                if s >= decontaminate.RETRIEVE - 1e-9 and min(q, r) >= decontaminate.OVERLAP:
                    found[doc, i] = max(found.get((doc, i), 0), round(s, 6))
    return found


def test_wand_finds_what_full_scoring_finds(spark, sf):
    docs, items = docs_of(spark, sf), common.table(spark, sf, "benchmark")
    want = plain_leaks(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == want and want
    left = {r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_wand_alone_against_full_scores():
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(5, 40)))) for i in range(200)]
    words = [hashing.word_hashes([t])[0] for _, t in items]
    df = Counter(x for w in words for x in set(w.tolist()))
    index = decontaminate.build_index(items, df, len(items), float(np.mean([len(w) for w in words])), 64)
    for _ in range(60):
        terms = sorted(rng.choice(len(index.vocabulary), 25, replace=False).tolist())
        full = defaultdict(float)
        for t in terms:
            for i, s in zip(index.lists[t].tolist(), index.impacts[t].tolist()):
                full[i] += s
        want = {i: round(s, 9) for i, s in full.items() if s >= 0.5}
        assert {i: round(s, 9) for i, s in decontaminate.block_max_wand(index, terms, 0.5)} == want


def test_leaks_in_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, PLAIN), (None, PLAIN), (3, None), (4, "")], "item_id long, text string")
    got = decontaminate.find_leaks(odd_docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (1, 2, None) for i in (1, None)}
    assert decontaminate.without_leaks(odd_docs, items).columns == odd_docs.columns
    assert decontaminate.find_leaks(odd_docs, items.limit(0)).collect() == decontaminate.find_leaks(no_docs, items).collect() == []
    assert decontaminate.without_leaks(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_items_in_many_indexes(spark, sf, monkeypatch):
    docs, items = docs_of(spark, sf), common.table(spark, sf, "benchmark")
    one = {tuple(r) for r in decontaminate.find_leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 7)
    many = {tuple(r) for r in decontaminate.find_leaks(docs, items).collect()}
    assert {(r[0], r[1]) for r in one} == {(r[0], r[1]) for r in many}


def test_edits_equal_the_full_table():
    rng = np.random.default_rng(4)
    for _ in range(60):
        part, words = (rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64) for _ in range(2))
        row = [0] * (len(words) + 1)
        for i, p in enumerate(part, 1):
            new = [i]
            for j, w in enumerate(words, 1):
                new.append(min(row[j - 1] + (p != w), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.edits(part, words) == min(row)


def test_edited_passages_are_found():
    """Items without an answer are verified whole; a changed word, in short parts too, hides nothing."""
    whole = " ".join(f"w{i}" for i in range(38))
    items = [(1, whole), (2, "what is the capital city of france ? it is lovely paris"), (3, "one two three four five six seven")]
    frequency = Counter(x for _, t in items for x in set(hashing.word_hashes([t])[0].tolist()))
    index = decontaminate.build_index(items, frequency, 3, 20.0, 80)
    found = lambda text: {h[1] for h in decontaminate.search(index, ["some text before " + text + " and some after"])}
    for item, text in items:
        words = text.split()
        for i in range(len(words)):
            assert item in found(" ".join([*words[:i], "zzz", *words[i + 1:]])), (item, i)
            assert item in found(" ".join([*words[:i], "zzz", *words[i:]])), (item, i)
    assert found(" ".join(whole.split()[:29])) == {1}
    assert found(" ".join("zzz" if i % 6 == 5 else w for i, w in enumerate(whole.split()))) == {1}
    assert found(" ".join(reversed(whole.split()))) == set()
    assert found("what is the capital city of france ? nobody knows") == set()


# 5 mixing

def test_raked_sums_meet_the_targets(spark):
    rows = [(s, la, t, 10 * (i + 1) * (j + 2) + 7 * k) for i, s in enumerate(["a", "b", None]) for j, la in enumerate(["x", "y"])
            for k, t in enumerate(["p", "q"])]
    cells = spark.createDataFrame(rows + [("z", "x", "p", 0)], "source string, lang string, topic string, tokens long")
    margins = (mixing.Margin("source", 0.0), mixing.Margin("lang", shares=(("x", 1.0), ("y", 3.0))), mixing.Margin("topic", 1.0))
    out = mixing.rake(cells, margins, 25).collect()
    total = sum(r["tokens"] for r in out)
    for s in ("a", "b", None):
        assert sum(r["weight"] for r in out if r["source"] == s) == pytest.approx(total / 3, rel=1e-6)
    assert sum(r["weight"] for r in out if r["lang"] == "y") == pytest.approx(total * 3 / 4, rel=1e-6)
    live = [r for r in out if r["tokens"]]
    assert sum(r["probability"] * r["tokens"] for r in live) == pytest.approx(mixing.SHARE * total)
    free = [r["probability"] * r["tokens"] / r["weight"] for r in live if r["probability"] < 1]
    assert max(free) == pytest.approx(min(free))
    most = mixing.rake(cells, margins, 25, share=0.95).collect()
    assert max(r["probability"] for r in most) == 1.0
    assert sum(r["probability"] * r["tokens"] for r in most if r["tokens"]) == pytest.approx(0.95 * total)
    assert [r["probability"] for r in out if not r["tokens"]] == [1.0]


def test_sampled_tokens_meet_the_targets(spark):
    """A cell taken whole is made up for by its own margins; a value short of tokens is taken whole."""
    rows = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 500), ("b", "y", 400), ("c", "x", 60), ("c", "y", 30)]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    margins = (mixing.Margin("source", shares=(("a", 0.4), ("b", 0.4), ("c", 0.2))), mixing.Margin("lang", shares=(("x", 1.0), ("y", 2.0))))
    got = Counter()
    for r in mixing.rake(cells, margins).collect():
        for name in ("source", "lang"):
            got[r[name]] += r["probability"] * r["tokens"]
        assert r["source"] != "c" or r["probability"] == pytest.approx(1.0, abs=1e-6)
    assert got == pytest.approx({"a": 455, "b": 455, "c": 90, "x": 1000 / 3, "y": 2000 / 3}, rel=1e-5)


# 6 chat

def test_round_trip_of_hostile_turns(spark):
    rows = [(1, 0, "user", "<|im_end|>\n<|im_start|>x<|im_sep|>"), (1, 1, "assistant", r"<\|im_end|> <\\|im_sep|> <|a"),
            (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 5, None, "a<"), (3, 4, "ro<|im_sep|>le", "|x"),
            (None, 1, "assistant", "é"), (4, None, "assistant", "<|im_start+|>")]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((role or "", text or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        assert out[c]["n_turns"] == len(turns)
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and out[c]["loss_chars"] == len(loss)
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_plain_turns_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b | c")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first()["formatted"] == "<|im_start|>user<|im_sep|>a < b | c<|im_end|>\n"


# 7 language

def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (7, 3)).astype(np.uint8)
    n = langid.HIDDEN
    w, u, c = rng.normal(0, 0.5, (256, 3 * n)), rng.normal(0, 0.5, (n, 3 * n)), rng.normal(0, 0.5, n)
    weight = rng.normal(0, 1, (7, 3, n))

    def loss(w, u, c):
        return float((langid._direction(x, w, u, c)[0].astype(np.float64) * weight).sum())

    _, kept = langid._direction(x, w, u, c)
    grads = langid._direction_back(x, u, kept, weight)
    for k, g in enumerate(grads):
        parts = [w, u, c]
        for at in ([(int(x[3, 1]), 5), (int(x[0, 0]), n + 2), (int(x[6, 2]), 2 * n)], [(1, 2), (0, n + 1), (3, 2 * n + 4)], [(2,), (5,), (0,)])[k]:
            up, down = [p.copy() for p in parts], [p.copy() for p in parts]
            up[k][at] += 1e-3
            down[k][at] -= 1e-3
            assert (loss(*up) - loss(*down)) / 2e-3 == pytest.approx(float(g[at]), rel=0.05, abs=0.01)


def test_held_out_accuracy(spark):
    out = langid.identify(docs_of(spark, "/root/testdata/sf0.01")).join(docs_of(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id")
    rows = out.filter("held_out AND lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_prediction_depends_on_the_text_alone():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 255, 256, 257, 1000, 3, 600)]
    net = langid.train([b"abc abd abe", b"xyz xyw xyv"], [0, 1], ["a", "b"])
    together = langid.predict(net, texts)
    for i, t in enumerate(texts):
        assert np.allclose(langid.predict(net, [t])[0], together[i], atol=1e-5)


def test_language_of_odd_rows(odd_docs):
    out = {r["doc_id"]: r for r in langid.identify(odd_docs).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (3, 4, 5, 10))
    nothing = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_training_reads_beyond_a_common_beginning(spark):
    rows = [(i, "HEADER " * 300 + f"body{i} " * 3000, "xx") for i in range(40)] + [(90 + i, "1 " * 1500 + "letters " * 3000, "yy") for i in range(9)]
    texts, labels = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert set(labels) == {"xx", "yy"} and max(map(len, texts)) <= langid.TRAIN_CHARS
    assert sum(b"body" in t for t in texts) > len(texts) / 3 and any(b"letters" in t for t in texts)


def test_all_of_many_labels_are_drawn(monkeypatch):
    """With more labels than a step has texts, the last ones are learned like the first."""
    monkeypatch.setattr(langid, "STEPS", 40)
    monkeypatch.setattr(langid, "BATCH", 2)
    texts = [x.encode() * 100 for x in "abcde"]
    net = langid.train(texts, list(range(5)), list("abcde"))
    assert langid.predict(net, texts).argmax(axis=1).tolist() == list(range(5))


# 8 near-duplicates

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_band_similarity_is_the_full_one():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a = hashing.labelled(rng.integers(0, 12, rng.integers(1, 40)).astype(np.uint64))
        b = np.delete(a, rng.integers(0, len(a), 2))
        if rng.random() < 0.4 and len(b) > 3:
            b = np.concatenate([b[2:], b[:2]])
        best = lcs(a.tolist(), b.tolist())
        full = best / (len(a) + len(b) - best) if len(b) else 0.0
        assert omh.band_similarity(a, b, 0.6) == pytest.approx(full if full >= 0.6 else 0.0)


def plain_classes(texts, threshold=0.8):
    seqs = {}
    for i, t in texts:
        seqs[i] = hashing.labelled(hashing.shingles(hashing.word_hashes([t or ""])[0], 5))
    by_text = {}
    parent = {i: i for i, _ in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(i, j):
        i, j = sorted((root(i), root(j)))
        parent[j] = i

    for i, t in texts:
        join(by_text.setdefault(t or "", i), i)
    heads = sorted(by_text.values())
    for x, i in enumerate(heads):
        for j in heads[x + 1:]:
            if len(seqs[i]) and len(seqs[j]) and omh.band_similarity(seqs[i], seqs[j], threshold):
                join(i, j)
    return {i: root(i) for i, _ in texts}


def test_classes_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    base = [" ".join(f"v{x}" for x in rng.integers(0, 500, 120)) for _ in range(6)]
    texts, i = [], 0
    for b in base:
        for _ in range(30):  # chains: each copy differs in one more word from the last
            words = b.split()
            words[int(rng.integers(len(words)))] = f"n{i}"
            b = " ".join(words) if rng.random() < 0.5 else b
            texts.append((i, " ".join(words)))
            i += 1
    texts += [(i, None), (i + 1, ""), (i + 2, "two words"), (i + 3, "two words"), (i + 4, "Two, words!")]
    got = {r["doc_id"]: r["class_id"] for r in omh.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == plain_classes(texts)


def test_copies_with_words_of_their_own_are_not_paired(spark, monkeypatch):
    """Copies of one text, many with so many words of their own that they are linked to none: few pairs are looked at, no link is lost."""
    rng = np.random.default_rng(10)
    base = [f"v{x}" for x in rng.integers(0, 500, 150)]
    texts = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 7)), replace=False):
            words[at] = f"n{i}" if rng.random() < 0.9 else "same"
        texts.append((i, " ".join(words)))
    seen, verify = [], omh.verify

    def counted(pairs, nodes, rows, least):
        seen.append(pairs.count())
        return verify(pairs, nodes, rows, least)

    monkeypatch.setattr(omh, "verify", counted)
    got = {r["doc_id"]: r["class_id"] for r in omh.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == plain_classes(texts)
    assert len(seen) == 3 and sum(seen[1:]) < 160


def test_classes_of_documents(spark, sf):
    texts = [tuple(r) for r in docs_of(spark, sf).select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in omh.near_duplicates(docs_of(spark, sf)).collect()}
    assert got == plain_classes(texts)
    heads = omh.first_of_classes(docs_of(spark, sf)).select("doc_id").collect()
    assert {r["doc_id"] for r in heads} == set(got.values())


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {tuple(r) for r in omh.components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# 9 records

def test_pieces_of_a_slice_are_looked_up_once_and_share_ids():
    """One lookup a word; capitals have the place of their lower-case word, and slices of any cut give the tokenizer's ids."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    own = records.Encoder(tokenizer_path())
    looked = []

    class Counted(records.Words):
        def __getitem__(self, piece):
            looked.append(piece)
            return super().__getitem__(piece)

    texts = ["Word word WORD word, ?! ...", "", " \n", "a\x1cb word", "<|im_end|> word", "ÀÉ? straße ß. 漢字 x1 don't " + "é" * 300, "word."]
    own.known = Counted()
    assert list(own.encode(["word word"]))[0] == np.array(tok.encode("word word", add_special_tokens=False).ids, "<u2").tobytes()
    assert own.spans[0].tolist() == [0, own.used]
    looked.clear()
    list(own.encode(["word word", "word"]))
    assert looked == ["word"] * 3
    used = own.used
    list(own.encode(["Word WORD"]))
    assert own.used == used and {"Word", "WORD", "word"} <= set(own.known)
    for some in (texts, texts[::-1], texts[:1], texts + texts):
        got = list(own.encode(some))
        assert got == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in some]
    own.forget()
    assert not own.known and list(own.encode(texts)) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert list(own.encode([])) == []


def test_records_equal_the_tokenizer(spark, sf, odd_docs, tmp_path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    docs = docs_of(spark, sf).select("doc_id", "text").unionByName(odd_docs.filter("doc_id > 4").withColumn("doc_id", F.col("doc_id") + 10**6).select("doc_id", "text"))
    at = 0
    rows = records.export(docs, tokenizer_path(), f"file://{tmp_path}/r").orderBy("doc_id").collect()
    for r, (doc, text) in zip(rows, sorted(docs.collect(), key=lambda r: r["doc_id"])):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    drawn = records.read_shuffled(spark, f"file://{tmp_path}/r", f"file://{tmp_path}/r-index").collect()
    assert sorted(r["doc_id"] for r in drawn) == sorted(r["doc_id"] for r in rows)
    assert [r["doc_id"] for r in drawn] != [r["doc_id"] for r in rows]
    assert {r["doc_id"]: len(r["ids"]) for r in drawn} == {r["doc_id"]: r["n_tokens"] for r in rows}


def test_damage_is_found():
    good = records.frame(struct.pack("<qB", 5, 0) + b"\x01\x00\x02\x00") + b"\n"
    assert records.read_record(good, 0)[0] == 5 and list(records.records(good + good)) == [(0, 13), (len(good), 13)]
    for at in (0, 9, 14, 22, 26):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises((ValueError, struct.error)):
            records.read_record(bytes(bad), 0)


# 10 suffix array

def plain_removal(texts):
    first = {}
    for doc, text in sorted(texts, key=lambda r: r[0]):
        raw = (text or "").encode()
        for s in range(len(raw) - 99):
            first.setdefault(raw[s:s + 100], (doc, s))
    out = {}
    for doc, text in texts:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if first[raw[s:s + 100]] != (doc, s):
                gone[s:s + 100] = b"\x01" * 100
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\x00" + gone))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removal(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeated_bytes(df).collect()}


def test_removal_equals_all_strings(spark, sf):
    docs = docs_of(spark, sf)
    assert removal(docs) == plain_removal(docs.select("doc_id", "text").collect())


def test_texts_that_share_an_id_keep_what_is_unrepeated(spark):
    rng = np.random.default_rng(8)
    a, b, c = ("".join(rng.choice(list("abcdefgh "), 300)) for _ in range(3))
    rows = [(1, a), (None, a), (None, b), (7, a), (7, c), (7, c), (9, None), (9, b + "!")]
    got = suffix.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got), key=repr)
    assert removed == sorted([(1, 300, 0), (None, 300, 300), (None, 300, 300), (7, 300, 300), (7, 300, 0), (7, 300, 0),
                              (9, 0, 0), (9, 301, 0)], key=repr)


@pytest.mark.parametrize("slice_bytes", [1 << 21, 700])
def test_removal_of_made_texts(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix, "SLICE_BYTES", slice_bytes)  # tasks run in forked workers of this process only with a new session
    rng = np.random.default_rng(3)

    def some(n):
        return "".join(rng.choice(list("abcdefgé "), n))

    shared, common_ = some(260), some(100)
    texts = [(i, some(int(rng.integers(0, 300))) + (shared[int(rng.integers(0, 80)):] if i % 3 else "") + some(40)) for i in range(40)]
    texts += [(50, "a" * 500), (51, "ab" * 400), (52, "a" * 99), (53, "a" * 100), (54, common_), (55, common_[1:] + "x"), (56, common_),
              (57, None), (58, ""), (59, shared + shared), (60, "é" * 200)]
    assert removal(spark.createDataFrame(texts, "doc_id long, text string")) == plain_removal(texts)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = np.frombuffer(bytes(rng.integers(97, 101, 3000).astype(np.uint8)), dtype=np.uint8)
    data = np.concatenate([data, data[100:900]])
    monkeypatch.setattr(suffix, "PLACE_BITS", np.uint64(9))
    starts = set()
    for owner, start, more, *_ in suffix._pieces(data, np.array([0, len(data)])):
        for s, m in zip(start.tolist(), more.tolist()):
            starts |= set(range(s, s + m + 1))
    assert starts == set(range(len(data) - 99))


def test_multikey_order_is_lexicographic():
    rng = np.random.default_rng(6)
    keys = [rng.integers(0, k, 500).astype(np.uint64) for k in (3, 4, 50)]
    order = suffix.multikey_order(keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys))
