import json

import pytest
from conftest import rows
from pyspark.sql import types as T

from deltascope.session import cut_lineage, shared_dir
from deltascope.sources import descriptions, logs, signatures
from deltascope.streaming import jobs

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType())])
RECORDS = [{"id": 1, "status": "success"}, {"id": 2, "status": 'a "quoted", one'}, {"id": 3, "status": None}]


def test_json_arrays_in_both_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS, indent=2))
    (tmp_path / "b.json").write_text("[\n" + ",\n".join(json.dumps(r) for r in RECORDS) + "\n]\n")
    free = logs.read_json_array(spark, str(tmp_path / "a.json"), SCHEMA)
    lines = logs.read_json_array(spark, str(tmp_path / "b.json"), SCHEMA, record_per_line=True)
    assert rows(free) == rows(lines) == sorted(((r["id"], r["status"]) for r in RECORDS), key=repr)


def test_json_lines_keep_corrupt_lines_apart(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": 1, "status": "x"}\n\n  \n{"id": 2, "sta\n{"id": 3}\n')
    good, bad = logs.read_json_lines(spark, str(tmp_path), SCHEMA)
    assert rows(good) == [(1, "x"), (3, None)]
    assert rows(bad) == [('{"id": 2, "sta',)]


def test_routed_logs_append_and_consolidate(spark, tmp_path):
    df = spark.createDataFrame([(2, "success"), (1, "failed"), (3, "success")], SCHEMA)
    path = str(tmp_path / "log")
    logs.write_routed(df, path)
    logs.write_routed(df, path)
    back = logs.read_routed(spark, path, SCHEMA)
    assert back.filter("bucket = 'success'").count() == 4 and back.count() == 6
    export = logs.consolidate(back.filter("bucket = 'success'").drop("bucket"), str(tmp_path / "out"))
    assert [r["id"] for r in export.collect()] == [2, 2, 3, 3]


def test_description_encodings(spark, tmp_path):
    head = "original_column_name,column_name,column_description,data_format,value_description\n"
    texts = {"utf8": ("utf-8-sig", "naïve – €"), "win": ("cp1252", "naïve – €"), "latin": ("latin1", "na\xefve \x81"), "wide": ("utf-16", "naïve ∑")}
    for name, (encoding, text) in texts.items():
        (tmp_path / f"{name}.csv").write_bytes((head + f'c,"C, x","{text}\nline ""2""",text,\n').encode(encoding))
    got = {r["table_name"]: r for r in descriptions.read_descriptions(spark, str(tmp_path / "*.csv")).collect()}
    assert {n: r["encoding"] for n, r in got.items()} == {"utf8": "UTF-8", "win": "cp1252", "latin": "ISO-8859-1", "wide": "UTF-16"}
    for name, (_, text) in texts.items():
        assert got[name]["original_column_name"] == "c"
        assert got[name]["column_description"] == f'{text}\nline "2"'


def test_mark_bytes_count_at_the_start_of_a_file_only(spark, tmp_path):
    head = "original_column_name,column_name,column_description,data_format,value_description\n"
    (tmp_path / "some name.csv").write_bytes(head.encode() + "a,b,one,text,x\n".encode() + b"\xff\xfe,b,\xe9t\xe9,text,x\n")
    (tmp_path / "long.csv").write_bytes(head.encode() + b"a,b," + b"\xe9" * 300_000 + b",text,x\n")
    got = descriptions.read_descriptions(spark, str(tmp_path / "*.csv")).collect()
    assert sorted((r["table_name"], r["encoding"], r["original_column_name"], r["column_description"][:3]) for r in got) == [
        ("long", "cp1252", "a", "ééé"), ("some name", "cp1252", "a", "one"), ("some name", "cp1252", "ÿþ", "été")]



def test_missing_store_is_remembered(spark, tmp_path):
    for _ in range(2):
        with pytest.raises(FileNotFoundError):
            signatures.load_store(spark, str(tmp_path / "none"))


def test_a_store_can_be_saved_after_a_failed_load(spark, tmp_path):
    path = str(tmp_path / "late")
    with pytest.raises(FileNotFoundError):
        signatures.load_store(spark, path)
    values = spark.createDataFrame([("t", "c", "some ring")], "table_name string, column_name string, value string")
    assert signatures.save_store(values, path, 20, 5).dictionary.count() == 1


def test_shared_folder_and_written_tables(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    saved = cut_lineage(df)
    assert rows(saved) == rows(df) and "Range" not in saved._jdf.queryExecution().optimizedPlan().toString()
    assert shared_dir(spark)


def write_lines(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def test_keys_are_written_once_across_restarts(spark, tmp_path):
    src, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    write_lines(src, "1.json", RECORDS + RECORDS)
    jobs.dedup(jobs.arriving(spark, str(src), SCHEMA), ["id"], out, cp)
    write_lines(src, "2.json", RECORDS + [{"id": 9, "status": "new"}])
    jobs.dedup(jobs.arriving(spark, str(src), SCHEMA), ["id"], out, cp)
    assert [r["id"] for r in spark.read.parquet(out).orderBy("id").collect()] == [1, 2, 3, 9]


def test_routing_goes_on_where_it_stopped(spark, tmp_path):
    src, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    write_lines(src, "1.json", RECORDS)
    jobs.route(jobs.arriving(spark, str(src), SCHEMA), out, cp)
    write_lines(src, "2.json", [{"id": 5, "status": "success"}])
    jobs.route(jobs.arriving(spark, str(src), SCHEMA), out, cp)
    assert rows(spark.read.parquet(out).select("id", "bucket")) == [(1, "success"), (2, "failure"), (3, "failure"), (5, "success")]


def test_every_batch_saves_a_snapshot(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    for i in range(3):
        write_lines(src, f"{i}.json", RECORDS)
    jobs.running_stats(jobs.arriving(spark, str(src), SCHEMA, files_per_trigger=1), "status", out, str(tmp_path / "cp"))
    saved = spark.read.parquet(out)
    assert saved.select("snapshot").distinct().count() >= 3
    assert {r["n"] for r in jobs.latest_snapshot(spark, out).collect()} == {3}
