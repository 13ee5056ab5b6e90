from pyspark.sql import functions as F

from cairn.functions.text import json_text
from cairn.operators import etl, evaluate, gates, route
from cairn.operators import pairs as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_decomposition_falls_back_to_the_question(spark):
    read = lambda t: one(spark, route.decomposed(F.lit(t), F.lit("q")))
    assert read('so ["a", " ", 3, "b", "c", "d"]') == ["a", "b", "c"]
    assert read("[") == read("no") == read("[]") == read("[1]") == ["q"]


def test_empty_verdicts_are_unparseable(spark):
    for reply in ("{}", "[1]", "none", '{"a": '):
        assert one(spark, gates.verdict_reasons(gates.judge_reply(F.lit(reply)), F.lit("simple"))) == ["judge_unparseable"]


def test_labels_in_any_case_and_missing_confidence(spark):
    read = lambda t: one(spark, route.llm_reply(F.lit(t)))
    assert read('{"label": "simple"}')[:3] == ("SIMPLE", 0.0, "llm")
    assert read('{"label": "SIMPLE", "confidence": null}').source == "llm:parse_fail"


def test_json_text_as_the_standard_library_writes_it(spark):
    import json

    for text in ('a "b" \\ c', "é 😀 \n\t\x01", "", "plain"):
        assert one(spark, json_text(F.lit(text))) == json.dumps(text)


def test_line_ends(spark):
    assert one(spark, etl.dehyphenated(F.lit("measure-\nment of a \n  b\nC-\nD"))) == "measurement of a b C- D"


def test_an_audit_stops_at_the_first_refusal(spark):
    q = spark.createDataFrame([(i, "simple", i) for i in range(5)], "id long, qtype string, place long")
    good = '{"answer_supported": true}'
    replies = spark.createDataFrame([(i, None if i == 3 else good, "try again in 5s" if i == 3 else None) for i in range(5)], "id long, reply string, quota string")
    fresh, row = gates.audited(q, q.where("id = 0").select("id"), replies, "place")
    assert sorted(r.id for r in fresh.collect()) == [1, 2]
    assert row.first().asDict() == {"already_done": 1, "new": 2, "total": 5, "stopped_before": 3, "suggested_wait": 5.0}


def test_clusters_without_a_recall_are_not_counted(spark):
    rows = spark.createDataFrame([("e", i, "t", None if i == 0 else 1.0, i, 1, 1, 1, 1.0, False, "SIMPLE", "llm", None) for i in range(3)],
        "experiment string, id long, qtype string, recall double, cluster long, llm_calls long, prompt_tokens long, completion_tokens long, latency_s double, escalated boolean, label string, route_source string, gold_route string")
    assert {r.n_clusters for r in evaluate.stratified(rows).collect()} == {2}
    asked = spark.createDataFrame([(i, ["p"] if i else []) for i in range(3)], "id long, gold_paper_ids array<string>")
    report = evaluate.report_rows(rows, asked, ("t",)).orderBy("place").collect()
    assert [(r.qtype, r.n_clusters, r.recall_lo, r.recall_clo) for r in report] == [("ALL", 1, 1.0, None), ("t", 1, 1.0, None)]


def test_splits_that_share_a_paper_show(spark):
    chunks = spark.createDataFrame([("p", "train"), ("p", "test"), ("q", "test")], "paper_id string, split string")
    row = P.split_isolation(chunks, F.col("split")).first()
    assert (row.papers, row.shared, row.uncovered) == (2, 1, 0)
