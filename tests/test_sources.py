"""Readers, writers and incremental forms on small files."""

import csv
import hashlib
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.sources import files
from veritrail.streaming import usage


def test_later_files_win(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"1": "first", "2": "two"}))
    (tmp_path / "b.json").write_text(json.dumps({"1": "second", "3": "three"}))
    got = {r["qid"]: r["value"] for r in files.read_merged(spark, f"{tmp_path}/*.json", T.StringType()).collect()}
    assert got == {"1": "second", "2": "two", "3": "three"}


def test_labelled_sources_of_all_layouts(spark, tmp_path):
    rows = [{"_id": "a", "question": "Who?"}, {"_id": "b", "question": "Where?"}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "y.json").write_text(json.dumps(rows))
    (tmp_path / "z.json").write_text(json.dumps({"data": rows}))
    (tmp_path / "k.json").write_text(json.dumps({"a": {"question": "Who?"}, "b": {"question": "Where?"}}))
    (tmp_path / "c.csv").write_text("_id,question\na,Who?\nb,Where?\n")
    specs = [f"{n.partition('.')[0]}:{tmp_path}/{n}" for n in ("x.jsonl", "y.json", "z.json", "k.json", "c.csv")]
    got = files.read_labelled(spark, specs, files.QUESTION)
    assert sorted((r["source"], r["_id"], r["question"]) for r in got.collect()) == sorted((s, i, q) for s in "xyzkc" for i, q in (("a", "Who?"), ("b", "Where?")))


def test_texts_are_tidied_and_cut_at_words(spark, tmp_path):
    (tmp_path / "one.txt").write_text("A  title\n\nand a\ttext ")
    (tmp_path / "two.txt").write_text("word " * 10)
    got = {r["title"]: r["passage"] for r in files.read_texts(spark, str(tmp_path), 22).collect()}
    assert got == {"one": "A title and a text", "two": "word word word word"}


def test_ids_by_presence_and_by_truth(spark):
    rows = spark.createDataFrame([("i", "u", "q", 0), ("", "u", "q", 1), (None, "", "q", 2), (None, None, None, 3)], "id string, _id string, qid string, n int")
    by = lambda prefer: [r[0] for r in rows.select(files.question_id(prefer_id=prefer, position=F.col("n")).alias("x"), "n").orderBy("n").select("x").collect()]
    assert by(True) == ["i", "", "", "3"]
    assert by(False) == ["u", "u", "q", "3"]


def test_predictions_by_order_of_fields(spark):
    rows = spark.createDataFrame([("", "x", "y", 0), ("p", "x", "y", 1), (None, None, "", 2)], "prediction string, response string, answer string, n int")
    take = lambda *a: [r[0] for r in rows.select(files.prediction(rows, *a).alias("x"), "n").orderBy("n").select("x").collect()]
    assert take() == ["x", "p", ""]
    assert take(("missing", "answer")) == ["y", "y", ""]


def test_fingerprints(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"")
    got = {r["name"]: (r["length"], r["sha256"]) for r in files.fingerprint(spark, f"{tmp_path}/*.bin").collect()}
    assert got == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in (("a.bin", b"abc"), ("b.bin", b""))}


def test_written_lines_and_tables_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "quoted", text'), ("2", None)], "_id string, question string")
    files.write_jsonl(rows.coalesce(1), f"{tmp_path}/out")
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*.json") for x in p.read_text().splitlines()]
    assert lines == [{"_id": "1", "question": 'a "quoted", text'}, {"_id": "2"}]
    files.write_csv(rows.coalesce(1), f"{tmp_path}/csv")
    with next((tmp_path / "csv").glob("part-*.csv")).open() as file:
        assert next(csv.reader(file)) == ["_id", "question"]
    files.write_empty(spark, f"{tmp_path}/empty", rows.schema)
    back = spark.read.parquet(f"{tmp_path}/empty")
    assert back.schema == rows.schema and back.count() == 0


def test_late_events_fall_out_and_windows_add_up(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-01 10:05:00", 1, "view", 2.0, "{}"), (2, "2026-01-01 10:55:00", 1, "view", 3.0, "{}"), (3, "2026-01-01 13:00:00", 2, "click", 1.0, "{}"), (4, "2026-01-01 10:01:00", 2, "view", 9.0, "{}")], "event_id long, t string, user_id long, event_type string, value double, props string")
    rows = rows.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props")
    for k, ids in enumerate(((1, 2), (3,), (4,))):
        rows.where(F.col("event_id").isin(*ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = usage.windowed(usage.event_stream(spark, f"{tmp_path}/in")).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None, k
    got = [(r["event_type"], r["n"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    # The window of 10 o'clock closed before event 4 came; that of 13 o'clock is still open.
    assert got == [("view", 2, 5.0)]
    batch = {(r["event_type"], r["window"]["start"].hour): r["n"] for r in usage.windowed(rows).collect()}
    assert sorted(batch.values()) == [1, 3]


def test_resumed_leaves_out_what_is_done(spark):
    todo, done = spark.createDataFrame([(1,), (2,), (3,)], "k long"), spark.createDataFrame([(2,), (2,)], "k long")
    assert sorted(r["k"] for r in usage.resumed(todo, done, "k").collect()) == [1, 3]
