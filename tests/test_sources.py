"""File formats: round trips and awkward inputs."""

import json

import pytest
from pyspark.sql import functions as F

from seqflow.sources import embeddings as E, fasta, hits as H, reports, runlogs as R
from seqflow.sources.tables import spread


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


@pytest.mark.parametrize("text,want", [
    (">seq1\nACDEF\n>seq2\nGHIKL\n", [("seq1", "ACDEF"), ("seq2", "GHIKL")]),
    (">s1\nMNPQR\n", [("s1", "MNPQR")]),
    (">seq1 d\nACDEF\nGH\n\n>seq2\nghikx-l\n>empty\n>s3\nAC\n", [("seq1", "ACDEFGH"), ("seq2", "ghikx-l"), ("s3", "AC")]),
    (">a\r\nAC\r\nDE\r\n>b\r\nFG", [("a", "ACDE"), ("b", "FG")]),
    ("", [])])
def test_fasta_records(spark, tmp_path, text, want):
    rows = fasta.read_fasta(spark, put(tmp_path, "x.fasta", text), with_order=True).orderBy("ord").collect()
    assert [(r.seq_id, r.seq) for r in rows] == want


def test_fasta_keeps_empty_on_request(spark, tmp_path):
    path = put(tmp_path, "x.fasta", ">a\n>b\nAC\n")
    assert [r.seq for r in fasta.read_fasta(spark, path, keep_empty=True).orderBy("seq_id").collect()] == ["", "AC"]


def test_fasta_order_over_many_splits(spark, tmp_path):
    for f in range(3):
        put(tmp_path, f"p{f}.fasta", "".join(f">r{f}_{i}\n{'ACDEF' * (1 + i % 7)}\n" for i in range(300)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = fasta.read_fasta(spark, str(tmp_path), with_order=True)
        assert rows.rdd.getNumPartitions() > 5
        got = [r.seq_id for r in rows.orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"r{f}_{i}" for f in range(3) for i in range(300)]


def test_fasta_write(spark, tmp_path):
    df = spark.createDataFrame([(0, "ACD"), (1, "EFG")], "i int, seq string").coalesce(1)
    path = fasta.write_fasta(df, F.format_string("seq_%d", "i"), path=str(tmp_path / "o"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text == ">seq_0\nACD\n>seq_1\nEFG\n"
    wrapped = fasta.write_fasta(df.withColumn("seq", F.lit("ACDEFGH")), "i", wrap=3)
    assert {r.seq for r in fasta.read_fasta(spark, wrapped).collect()} == {"ACDEFGH"}
    assert path == str(tmp_path / "o")


def test_rounds_are_told_apart_by_value(spark):
    df = spark.createDataFrame([(1, "a", "AC"), (10, "b", "DE"), (1, "c", "FG")], "round int, id string, seq string")
    path = fasta.write_fasta(df, "id", partition_by=["round"])
    got = fasta.read_fasta(spark, path).where("round = 1")
    assert {r.seq_id for r in got.collect()} == {"a", "c"}


def test_labels(spark):
    df = spark.createDataFrame([("x",), ("y",)], "label string")
    assert {r.label for r in fasta.read_labels(spark, fasta.write_labels(df, "label")).collect()} == {"x", "y"}


@pytest.mark.parametrize("layout", list(H.LAYOUTS))
def test_hit_layouts(spark, layout):
    names = [c.split() for c in H.LAYOUTS[layout].split(", ")]
    row = tuple("q" if t == "string" else 1 if t == "int" else 0.5 for _, t in names)
    df = spark.createDataFrame([row], H.LAYOUTS[layout])
    back = H.read_hits(spark, H.write_hits(df, layout), layout)
    assert [tuple(r) for r in back.collect()] == [row] and H.SCORE[layout] in back.columns


def test_embedding_csv(spark):
    df = spark.createDataFrame([("a", [1.0, 0.25]), ("b", [2.5, -1e-9])], "id string, v array<double>")
    back = E.read_embedding_csv(spark, E.write_embedding_csv(df, "id", "v", 2))
    assert {r.label: r.embedding for r in back.collect()} == {"a": [1.0, 0.25], "b": [2.5, -1e-9]}


def test_embedding_store_cap(spark):
    df = spark.createDataFrame([(b, 0, [1.0]) for b in (0, 10, 11, 2500)], "batch_no long, seq_idx int, embedding array<double>")
    assert E.read_embeddings(spark, E.write_embeddings(df)).count() == 4


def test_indented_run_metrics(spark, tmp_path):
    def line(ts, req, total):
        return {"timestamp": ts, "dt": 10.0, "requests": req, "tokens": req * 7, "req_per_sec": req / 10, "tok_per_sec": 1.0,
                "total_tokens": total, "queue_tokens": 0, "work_queue_depth": 3, "gpu_stats": {"dev:0": {"processed": req}, "dev:1": {"processed": 1}}}
    obj = {"requests": 5, "total_tokens": 35, "errors": 0, "timeseries": [line(1.5, 2, 14), line(11.5, 3, 35)],
           "gpu_stats": {"dev:0": {"processed": 5}, "dev:1": {"processed": 1}}}
    m = R.read_run_metrics(spark, put(tmp_path, "m.json", json.dumps(obj, indent=2)), multiline=True)
    assert [(r.timestamp, r.requests, r.gpu_stats["dev:0"].processed) for r in R.metric_intervals(m).orderBy("timestamp").collect()] == [(1.5, 2, 2), (11.5, 3, 3)]
    assert {(r.device, r.processed) for r in R.device_totals(m).collect()} == {("dev:0", 5), ("dev:1", 1)}


def test_telemetry_and_client(spark, tmp_path):
    obj = {"checkpoint_metadata": {"hostname": "n1", "timestamp": 30, "num_samples": 2}, "metrics": [
        {"timestamp": 25, "hostname": "n1", "metrics": {"cpu_percent": 3.5, "gpu_0_utilization": 90.0, "gpu_11_power_watts": 250.0}},
        {"timestamp": 30, "hostname": "n1", "metrics": {"load_average_1m": 1.0}}]}
    rows = R.telemetry_samples(R.read_telemetry(spark, put(tmp_path, "t.json", json.dumps(obj, indent=1)), multiline=True)).collect()
    assert {(r.timestamp, r.gpu, r.gauge, r.value) for r in rows} == {
        (25, None, "cpu_percent", 3.5), (25, 0, "utilization", 90.0), (25, 11, "power_watts", 250.0), (30, None, "load_average_1m", 1.0)}
    c = R.read_client_outcomes(spark, put(tmp_path, "c.json", json.dumps(
        {"submitted": 3, "successful": 2, "failed": 1, "error_msgs": ["boom"], "retries": 4})), multiline=True).first()
    assert (c.submitted, c.failed, c.error_msgs, c.retries) == (3, 1, ["boom"], 4)


def test_reports(spark, tmp_path):
    df = spark.sql("SELECT 't' AS target, 1 AS round, named_struct('min', 1.0D, 'max', 2.0D, 'mean', 1.5D) AS structure")
    r = reports.read_evaluations(spark, reports.write_evaluations(df)).first()
    assert (r.target, r.structure["mean"], r.embedding) == ("t", 1.5, None)
    reports.write_parameters(spark.sql("SELECT 3 AS rounds, 42 AS seed"), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first().seed == 42


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == 2 * cores
    assert spread(spark.range(0, 10, 1, 3 * cores), "id").rdd.getNumPartitions() == 3 * cores
