import json

import pytest
from pyspark.sql import functions as F

from lexiqua.plans.staging import fresh_path, release, staging_root
from lexiqua.sources import files, requests
from lexiqua.streaming import results as stream


def test_clean_names():
    names = {"Lead ID ": "lead_id", "e-mail": "email", "_c0": "unnamed_0", "ok_1": "ok_1", "A  b\tC!": "a_b_c"}
    assert {n: files.clean_name(n) for n in names} == names


def test_csv_with_line_breaks_and_an_empty_header(spark, tmp_path):
    text = ',lead_id,Form Text,target\n0,a1,"two\nlines, and ""quotes""",sales\n1,b2,plain,support\n'
    (tmp_path / "form.csv").write_text(text)
    df = files.read_csv(spark, str(tmp_path / "form.csv"))
    assert df.columns == ["unnamed_0", "lead_id", "form_text", "target"]
    assert [r["form_text"] for r in df.orderBy("lead_id").collect()] == ['two\nlines, and "quotes"', "plain"]


def test_found_at_any_depth(spark, tmp_path):
    for place in ("a/b", "c"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "wanted.csv").write_text("x\n1\n")
    (tmp_path / "c" / "other.csv").write_text("x\n2\n")
    assert files.read_found(spark, str(tmp_path), "wanted.csv", "csv", "x string").where("x = '1'").count() == 2


def test_latest_snapshot_is_numeric(spark):
    path = fresh_path(spark, "snap")
    assert files.read_latest_snapshot(spark, path) is None
    for n in (2, 10):
        files.write_snapshot(spark.range(n), path, n)
    latest = files.read_latest_snapshot(spark, path)
    assert latest.count() == 10 and latest.first()["checkpoint"] == 10
    files.write_snapshot(spark.range(3), path, 10)
    assert files.read_latest_snapshot(spark, path).count() == 3


def line(row_id, content):
    return json.dumps({"custom_id": row_id, "response": {"body": {"choices": [{"message": {"content": content}}]}}})


def test_later_lines_win_and_bad_lines_are_told(spark, tmp_path):
    lines = [line("1", "old"), "{broken", line("1", "new"), line("99", "x"), '{"custom_id": "2", "response": {"body": {}}}', line("abc", "x")]
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n")
    df = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    merged, rejects = requests.merge_results(df, "id", requests.read_results(spark, str(tmp_path)), "answer")
    assert {r["id"]: r["answer"] for r in merged.collect()} == {1: "new", 2: None, 3: None}
    assert sorted((r["id"] or 0, r["reason"]) for r in rejects.collect()) == [
        (0, "bad id"), (0, "corrupt line"), (2, "no content"), (99, "unknown id"),
    ]


def test_stream_reads_each_file_once_and_compacts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    log, place, snaps = (fresh_path(spark, n) for n in ("log", "place", "snaps"))

    def answers(**kw):
        return {r["id"]: r["content"] for r in stream.current(spark, log, snaps, **kw).collect()}

    (source / "a.jsonl").write_text("\n".join([line("1", "a"), line("2", "b"), "{bad"]) + "\n")
    stream.ingest(spark, str(source), log, place)
    assert answers() == {1: "a", 2: "b"}
    stream.ingest(spark, str(source), log, place)
    assert stream.read_log(spark, log).count() == 3
    stream.compact(spark, log, snaps, upto=0)
    (source / "b.jsonl").write_text(line("2", "b2") + "\n" + line("3", "c") + "\n")
    stream.ingest(spark, str(source), log, place)
    assert answers() == {1: "a", 2: "b2", 3: "c"}
    assert stream.read_log(spark, log).where(F.col("reason") == "corrupt line").count() == 1


def test_request_fields(spark):
    df = spark.createDataFrame([(7, 'say "hi"\nnow')], "id long, t string")
    path = fresh_path(spark, "req")
    files.write_json_lines(requests.batch_requests(df, "id", "t", "m", 0.5, "sys", 9), path)
    rows = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert rows == [{
        "custom_id": "7", "method": "POST", "url": "/v1/chat/completions",
        "body": {"model": "m", "temperature": 0.5, "messages": [
            {"role": "system", "content": "sys"}, {"role": "user", "content": 'say "hi"\nnow'}], "max_tokens": 9},
    }]


def test_escaped_breaks_split_one_file(spark, tmp_path):
    texts = ["plain", "a\nb\r\nc", "\\n is no break", "\\", "\\\n\\\\r", 'say "x"\n', " edge ", None]
    rows = [(i, texts[i % len(texts)]) for i in range(4000)]
    path = str(tmp_path / "csv")
    files.write_csv(spark.createDataFrame(rows, "id int, `Some Text` string").coalesce(1), path, escaped_breaks=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        back = files.read_csv(spark, path, "id int, `Some Text` string", multi_line=False, escaped_breaks=True)
        assert back.columns == ["id", "some_text"] and back.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, back.collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_staging_follows_the_session_setting(spark, tmp_path):
    other = spark.newSession()
    other.conf.set("spark.app.note", "x")
    root = staging_root(other)
    setting = spark.conf.get("spark.checkpoint.dir", None)
    assert root.endswith(spark.sparkContext.applicationId)
    assert setting is None or root.startswith(setting)


def test_staging_without_a_setting_goes_below_the_warehouse():
    class Context:
        applicationId = "app"

    class Conf:
        def get(self, key, default=None):
            return "hdfs://host/warehouse" if key == "spark.sql.warehouse.dir" else default

    class Session:
        sparkContext, conf = Context(), Conf()

    assert staging_root(Session()) == "hdfs://host/warehouse/_staged/app"


def test_release_removes_only_this_application(spark, tmp_path):
    class Session:
        sparkContext = spark.sparkContext
        _root = str(tmp_path)

        class conf:
            @staticmethod
            def get(key, default=None):
                return Session._root

    mine, other = tmp_path / spark.sparkContext.applicationId / "table", tmp_path / "another" / "table"
    for folder in (mine, other):
        folder.mkdir(parents=True)
        (folder / "part").write_text("x")
    release(Session())
    assert not mine.parent.exists() and (other / "part").exists()
