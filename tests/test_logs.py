"""Run logs of rows with different fields, nested ones, blank and broken lines."""

from pyspark.sql import functions as F

from embedlens.sources import logs as L


def test_rows_of_any_shape(spark, tmp_path):
    for run, lines in {7: ['{"step": 1, "loss": 0.5, "lr": 1}', "", '{"step": 2, "loss": "n/a"}', "   ", "not json", "[1, 2]", '{"eval_step": 2, "scores": {"recall@10": 0.25}}'], 8: ['{"step": 9007199254740993, "loss": 1e-3, "note": "x"}', '{"step": 3, "loss": null}', '{"eval_step": 5, "scores": {}}']}.items():
        (tmp_path / f"run_id={run}").mkdir()
        (tmp_path / f"run_id={run}" / "metrics.jsonl").write_text("\n".join(lines) + "\n")
    logs = L.read_logs(spark, str(tmp_path))
    shapes = {r.run_id: r for r in L.shapes(logs).collect()}
    assert (shapes[7].rows, shapes[7].bad, shapes[8].rows, shapes[8].bad) == (3, 2, 3, 0)
    assert "recall@10" in shapes[7]["shape"] and "note" in shapes[8]["shape"]
    assert {tuple(r) for r in L.series(logs, "$.step", loss="$.loss").collect()} == {(7, 1, 0.5), (8, 9007199254740993, 1e-3)}
    assert {tuple(r) for r in L.series(logs, "$.eval_step", r="$.scores['recall@10']").collect()} == {(7, 2, 0.25)}
    assert {tuple(r) for r in L.last_with(logs, "$.step", "$.lr").collect()} == {(7, 1, 1.0)}
    got = {r.field: (r.rows, r.runs) for r in L.fields_of(logs).collect()}
    assert got == {"step": (4, 2), "loss": (4, 2), "lr": (1, 1), "eval_step": (2, 2), "scores": (2, 2), "note": (1, 1)}


def test_written_logs_keep_their_order(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 3).alias("r"), (300 - F.col("id")).alias("s"))
    L.write_logs(rows, str(tmp_path / "logs"), "r", "s", F.to_json(F.struct("s")))
    for run in range(3):
        (file,) = (tmp_path / "logs" / f"run_id={run}").glob("*.txt")
        steps = [int(x[5:-1]) for x in file.read_text().split()]
        assert steps == sorted(steps) and len(steps) == 100
    assert L.series(L.read_logs(spark, str(tmp_path / "logs")), "$.s").count() == 300


def test_packed_logs_have_the_rows_of_logs_a_run_in_few_files(spark, tmp_path):
    rows = spark.range(900).select(F.when(F.col("id") % 300 != 5, F.col("id") % 300 - 7).alias("r"), (900 - F.col("id")).alias("s"))
    line = F.when(F.col("s") % 7 == 0, F.lit("no\tjson")).when(F.col("s") % 11 == 0, F.lit(" ")).otherwise(F.to_json(F.struct("s", F.lit("a\tb").alias("note"))))
    L.write_logs(rows, str(tmp_path / "one"), "r", "s", line)
    L.pack_logs(rows, str(tmp_path / "packed"), "r", "s", line)
    want, got = ([(r.run_id, r.j) for r in logs.selectExpr("run_id", "to_json(row) as j").orderBy("run_id", "j").collect()] for logs in (L.read_logs(spark, str(tmp_path / "one")), L.read_packed(spark, str(tmp_path / "packed"))))
    assert got == want and len(got) > 800
    assert len(list((tmp_path / "packed").glob("*.txt"))) <= 4
    seen = {}
    for file in (tmp_path / "packed").glob("*.txt"):
        for line in file.read_text().splitlines():
            run, text = line.split("\t", 1)
            assert seen.setdefault(run, file) == file


def test_queries_of_logs_write_no_file_a_run(spark, tmp_path):
    from embedlens.plans import q_dedup_runs

    spark.range(5000).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "id % 1000 as user_id", "'view' as event_type", "id / 2 as value").write.parquet(f"{tmp_path}/events.parquet")
    logs = q_dedup_runs.logs_of(spark, str(tmp_path))
    assert logs.count() == 5000 and len(logs.inputFiles()) <= 8
