"""Sources, sinks, the inference hook."""

import os
import tempfile
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanpref.operators import confusion
from spanpref.operators.evaluation_input import evaluation_table
from spanpref.operators.inference import empty_answer_factory, generate_predictions
from spanpref.plans import queries as Q
from spanpref.sources import fixtures, sinks
from spanpref.sources.arrow_shards import register
from spanpref.sources.confusion_csv import read_confusion_csv, write_confusion_csv

SF = "/root/testdata/sf0.001"


def test_confusion_csv_roundtrip(spark):
    edges = Q.QUERIES["code_confusion_edges"](spark, SF).where(F.col("model") == "model_a").drop("model")
    d = tempfile.mkdtemp(prefix="spanpref-test-", dir="/tmp")
    write_confusion_csv(edges, os.path.join(d, "code"), "code")
    back = read_confusion_csv(spark, os.path.join(d, "code"), "model_a")
    assert sorted((r.gt, r.pred, r.cnt) for r in back.collect()) == sorted(
        (r.ground_truth, r.predicted, r["count"]) for r in edges.collect()
    )


def test_inference_hook(spark):
    ex, _ = Q.fixture(spark, SF)
    pr = generate_predictions(ex, empty_answer_factory(), "stub")
    ev = confusion.with_label_sets(evaluation_table(ex, pr))
    assert ev.where(F.size("pred_codes") > 0).count() == 0
    assert pr.count() == ex.count()


def test_confusion_csv_last_row_wins(spark):
    d = tempfile.mkdtemp(prefix="spanpref-test-", dir="/tmp")
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write("Ground_Truth_Code,Predicted_Code,Count\nSDOH,X,3\nA,B,1\nSDOH,X,5\n")
    got = sorted((r.gt, r.pred, r.cnt) for r in read_confusion_csv(spark, d, "m").collect())
    assert got == [("A", "B", 1), ("SDOH", "X", 5)]


def test_long_conversations_and_documents_keep_unique_ids(spark):
    turns = spark.createDataFrame([(c, t, "user", f"turn {t}") for c in (0, 1) for t in range(1500)], "conv_id long, turn long, role string, text string")
    ex = fixtures.examples(fixtures.sentences_from_conversations(turns))
    assert ex.count() == 3000 and ex.select("ex_id").distinct().count() == 3000


def _stream(path, table, rows, options=None):
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, table.schema, options=options) as w:
        w.write_table(table, max_chunksize=rows)


def _shard(k, n):
    return pa.table({
        "query": [f"q{k}-{i}" for i in range(n)],
        "answer": pa.array(['{"results":[]}' if i % 3 else None for i in range(n)], pa.large_string()),
        "id": pa.array(range(n), pa.int32()),
        "tags": [[f"t{i}", None] for i in range(n)],
    })


def test_arrow_shards_split_by_batch(spark, tmp_path):
    register(spark)
    for k in range(2):
        _stream(str(tmp_path / f"data-{k:05d}.arrow"), _shard(k, 1000), 50)
    (tmp_path / "state.json").write_text("{}")
    for uri in (str(tmp_path), tmp_path.as_uri()):
        whole = spark.read.format("arrow_shards").load(uri)
        assert whole.dtypes == [("query", "string"), ("answer", "string"), ("id", "int"), ("tags", "array<string>")]
        assert whole.rdd.getNumPartitions() == 2
        split = spark.read.format("arrow_shards").option("split_bytes", 4000).load(uri)
        assert split.rdd.getNumPartitions() >= 20
        rows = sorted(tuple(r) for r in split.collect())
        assert rows == sorted(tuple(r) for r in whole.collect()) and len(rows) == 2000
        assert rows[0] == ("q0-0", None, 0, ["t0", None])
    one = spark.read.format("arrow_shards").option("split_bytes", 4000).load(str(tmp_path / "data-00001.arrow"))
    assert one.count() == 1000 and one.rdd.getNumPartitions() >= 10


def test_arrow_shards_give_the_columns_asked_for(spark, tmp_path):
    register(spark)
    _stream(str(tmp_path / "a.arrow"), _shard(0, 10), 4)
    got = spark.read.format("arrow_shards").schema("id long, query string, missing double").load(tmp_path.as_uri())
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"q0-{i}", None) for i in range(10)]


def test_arrow_files_and_dictionaries(spark, tmp_path):
    register(spark)
    table = pa.table({"query": pa.array(["a", "b", "a", None]).dictionary_encode(), "n": [1, 2, 3, 4]})
    _stream(str(tmp_path / "a.arrow"), table, 2)
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table, max_chunksize=1)
    got = spark.read.format("arrow_shards").option("split_bytes", 1).load(str(tmp_path))
    assert got.dtypes == [("query", "string"), ("n", "bigint")]
    assert got.rdd.getNumPartitions() == 1 + 4
    assert sorted((r.query or "", r.n) for r in got.collect()) == sorted([("a", 1), ("b", 2), ("a", 3), ("", 4)] * 2)
    compressed = tmp_path / "zipped"
    compressed.mkdir()
    _stream(str(compressed / "c.arrow"), _shard(3, 100), 10, pa.ipc.IpcWriteOptions(compression="zstd"))
    assert spark.read.format("arrow_shards").option("split_bytes", 1).load(str(compressed)).select("id").distinct().count() == 100


def test_generators_are_built_once_per_worker(spark, tmp_path):
    log = str(tmp_path)

    def factory():
        open(os.path.join(log, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda prompts: [None if p == "p3" else p.upper() for p in prompts]

    ex = spark.createDataFrame([(i, f"p{i}") for i in range(200)], "ex_id int, query string").repartition(50)
    out = generate_predictions(ex, factory, "m", batch_rows=2)
    assert {r.ex_id: r.pred_text for r in out.collect()} == {i: "" if i == 3 else f"P{i}" for i in range(200)}
    assert out.where("pred_text = ''").count() == 1
    calls = os.listdir(log)
    assert 0 < len(calls) == len({c.split("-")[0] for c in calls}) < 50  # one a worker, of 100 tasks


def test_generated_rows_keep_their_order(spark):
    ex = spark.range(0, 500, 1, 1).selectExpr("id AS ex_id", "cast(id AS string) AS query")
    out = generate_predictions(ex, lambda: (lambda prompts: prompts), "m", batch_rows=7)
    assert [r.pred_text for r in out.collect()] == [str(i) for i in range(500)]


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_writing_one_model_leaves_the_others(spark, tmp_path, kind):
    path = str(tmp_path / "sink")
    df = spark.createDataFrame([(m, i, f"{m}{i}é") for m in "abc" for i in range(5)], "model string, ex_id long, text string")
    sinks.write_models(df, path, kind)
    files = {m: set(os.listdir(os.path.join(path, f"model={m}"))) for m in "abc"}
    other = df.where("model = 'b' AND ex_id < 2").withColumn("text", F.lit("new"))
    for _ in range(2):  # again: the same result
        sinks.write_models(other, path, kind)
        back = spark.read.schema(df.schema).format(kind).load(path)
        rows = sorted(tuple(r) for r in back.select("model", "ex_id", "text").collect())
        assert rows == sorted([(m, i, f"{m}{i}é") for m in "ac" for i in range(5)] + [("b", 0, "new"), ("b", 1, "new")])
    assert all(set(os.listdir(os.path.join(path, f"model={m}"))) == files[m] for m in "ac")


def test_first_n(spark):
    df = spark.range(20).withColumnRenamed("id", "ex_id").repartition(4)
    assert [r.ex_id for r in sinks.first_n(df, 3).collect()] == [0, 1, 2] and sinks.first_n(df, 0).count() == 20


def test_examples_are_made_once(spark):
    """What a query reads of the fixture comes from the shared folder, not from its tables and draws again."""
    for source in ("conversations", "documents"):
        for df in Q.fixture(spark, SF, source):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Generate" not in plan and "/spanpref/examples-" in plan
        ex, _ = Q.fixture(spark, SF, source, keep_query=False)
        assert "query" not in ex.columns


def test_gold_is_made_after_the_sentences_are_spread(spark):
    """One file's sentences are dealt out before the draws, which are most of the work."""
    turns = spark.createDataFrame([(c, t, "user", f"turn {t}") for c in (0, 1) for t in range(5)], "conv_id long, turn long, role string, text string")
    plan = fixtures.examples(fixtures.sentences_from_conversations(turns))._jdf.queryExecution().optimizedPlan().toString()
    spread = plan.index("RepartitionByExpression")
    assert "md5" in plan[:spread] and "md5" not in plan[spread:]
