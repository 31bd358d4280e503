"""The pipeline's stages against plain versions, on what the stage before kept."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from deltascope.llm import common, mixing, quality
from deltascope.llm.queries import tokenizer_path

from .test_operators import plain_classes, plain_leaks


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = common.table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, sf)
        out.append((name, docs, kept.persist()))
        docs = out[-1][2]
    yield out
    for _, _, kept in out:
        kept.unpersist()


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "near duplicates", "decontamination", "mixing", "token files"]
    for _, docs, kept in stages[:-1]:
        assert kept.columns == docs.columns and kept.count() > 0


def test_rules(stages):
    _, docs, kept = stages[0]
    assert ids(kept) == ids(quality.measure_quality(docs).filter("kept"))


def test_one_of_each_class(stages):
    _, docs, kept = stages[1]
    assert ids(kept) == set(plain_classes([tuple(r) for r in docs.select("doc_id", "text").collect()]).values())
    assert kept.count() == len(ids(kept))


def test_leaks_go(spark, sf, stages):
    _, docs, kept = stages[2]
    items = common.table(spark, sf, "benchmark").select("item_id", "text").collect()
    found = plain_leaks(docs.select("doc_id", "text").collect(), items)
    assert ids(kept) == ids(docs) - {d for d, _ in found}


def test_mixture_is_the_sampled_part(stages):
    _, docs, kept = stages[3]
    assert ids(kept) == ids(mixing.mix_report(docs).filter("sampled"))


def test_files_hold_the_tokens(stages):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    _, docs, kept = stages[4]
    texts = dict(docs.select("doc_id", "text").collect())
    rows = sorted(kept.collect())
    assert [r["doc_id"] for r in rows] == sorted(texts)
    at = 0
    for r in rows:
        encoded = np.array(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(encoded), zlib.crc32(encoded.tobytes()))
        at += len(encoded)


def test_run_chains_the_stages(spark, sf, stages):
    assert ids(corpus_pipeline.run(spark, sf)) == ids(stages[-1][2])


def test_odd_and_empty_documents(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, sf).persist()
            assert name == "token files" or docs.columns == columns


def test_token_files_leave_no_words_in_the_workers(spark):
    import os

    from deltascope.llm import records
    from deltascope.llm.queries import tokenizer_path
    docs = spark.createDataFrame([(i, f"word{i} and other{i}, words") for i in range(40)], "doc_id long, text string")
    path = tokenizer_path()

    def left(_):
        yield os.getpid(), len(records.encoder(path).known)

    got = sorted(tuple(r) for r in corpus_pipeline.tokens(spark, docs, "").collect())
    assert got == sorted(tuple(r) for r in records.export(docs, path, keep_words=False).collect())
    met = spark.sparkContext.parallelize(range(8), 8).mapPartitions(left).collect()
    assert all(n == 0 for _, n in met), met
    assert got == sorted(tuple(r) for r in records.export(docs, path).collect())
