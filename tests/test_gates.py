import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import gates as G

GOOD = {"answer_supported": True, "needs_all_passages": True, "passage_1_contribution": "a", "passage_2_contribution": "b", "joint_reason": "c", "same_quantity": True}


@pytest.mark.parametrize("reply, qtype, reasons", [
    (GOOD, "multi_hop", []), (GOOD | {"needs_all_passages": False}, "multi_hop", ["not_all_passages_needed"]), (GOOD | {"quantities_comparable": False}, "multi_hop", ["quantities_not_comparable"]),
    (GOOD | {"same_quantity": None}, "temporal", ["different_quantity"]), (GOOD | {"answer_supported": False}, "simple", ["answer_not_supported"]), ({"answer_supported": True}, "simple", []),
    (GOOD | {"joint_reason": "  "}, "chain", ["missing_joint_reason"]), ("nonsense", "simple", ["judge_unparseable"]),
    ('{"answer_supported": true, // yes\n"needs_all_passages": false}', "simple", []),
])
def test_verdicts(spark, reply, qtype, reasons):
    text = reply if isinstance(reply, str) else json.dumps(reply)
    got = spark.range(1).select(G.verdict_reasons(G.judge_reply(F.lit(text)), F.lit(qtype)).alias("r")).first().r
    assert got == reasons


@pytest.mark.parametrize("votes, name", [([True] * 3, "stable_pass"), ([False] * 2, "stable_fail"), ([True, False], "unstable"), ([], None)])
def test_stability(spark, votes, name):
    df = spark.createDataFrame([(votes,)], "v array<boolean>")
    assert df.select(G.stability_class(F.col("v")).alias("x")).first().x == name


def test_only_ids_of_every_run_count(spark):
    runs = spark.createDataFrame([(1, "a", True), (2, "a", False), (1, "b", True)], "run int, id string, ok boolean")
    got = G.judged_in_every_run(runs)
    assert [(r.id, r.verdicts) for r in got.collect()] == [("a", [True, False])]
    assert G.pairwise_agreement(got).first().pairwise_agreement == 0.0
    assert G.pairwise_agreement(got.where("false")).first().pairwise_agreement is None


BASE = dict(id="q", question="What is H0 here?", qtype="simple", gold_chunk_ids=["c"], gold_paper_ids=["p"], split="test", status="accepted", notes="review:human", validation='{"judge_model": "j", "generator_model": "g"}')
SCHEMA = "id string, question string, qtype string, gold_chunk_ids array<string>, gold_paper_ids array<string>, split string, status string, notes string, validation string, line int"


def gated(spark, *changes, verdicts=(True, True, True), **options):
    rows = [tuple((BASE | {"id": f"q{i}"} | c)[k] for k in BASE) + (i,) for i, c in enumerate(changes)]
    q = spark.createDataFrame(rows, SCHEMA)
    v = spark.createDataFrame([(f"q{i}", list(verdicts)) for i in range(len(changes))], "id string, verdicts array<boolean>")
    return G.finalise_reasons(q, v, **options)


@pytest.mark.parametrize("change, reason", [
    ({}, []), ({"status": "candidate"}, ["not_accepted"]), ({"split": "train"}, ["not_test_split"]), ({"notes": "review:llm"}, ["no_human_review"]), ({"qtype": "odd"}, ["unknown_qtype"]),
    ({"qtype": "multi_hop"}, ["too_few_gold_chunks", "needs_two_papers"]), ({"qtype": "chain", "gold_chunk_ids": ["a", "b"], "gold_paper_ids": ["p", "q"]}, ["chain_must_be_single_paper"]),
    ({"validation": "broken"}, ["no_judge_model_recorded"]), ({"validation": '{"judge_model": "config-default"}'}, ["no_judge_model_recorded"]),
])
def test_gates_name_one_defect(spark, change, reason):
    assert gated(spark, change).first().reasons == reason


def test_stability_gates(spark):
    assert gated(spark, {}, verdicts=[True, True]).first().reasons == ["too_few_judge_runs"]
    assert gated(spark, {}, verdicts=[True, False, True]).first().reasons == ["judge_unstable"]
    assert gated(spark, {}, verdicts=[False] * 3).first().reasons == ["judge_stable_fail"]
    assert gated(spark, {}, stability_model="g").first().reasons == ["stability_self_judged"]
    q = gated(spark, {}).drop("reasons")
    assert G.finalise_reasons(q, spark.createDataFrame([], "id string, verdicts array<boolean>")).first().reasons == ["no_stability_record"]


def test_rejected_questions_register_no_key(spark):
    g, h = {"gold_chunk_ids": ["G"]}, {"gold_chunk_ids": ["H"]}
    rows = gated(spark, h | {"question": "Same question, twice?"}, g | {"question": "same QUESTION twice"}, g | {"question": "Another one entirely"})
    got = {r.id: (r.final, r.reasons) for r in G.finalise(rows, "line").collect()}
    assert got == {"q0": (True, []), "q1": (False, ["duplicate_question"]), "q2": (True, [])}
    again = gated(spark, g | {"question": "First of them all"}, g | {"question": "Second of them all"})
    assert [r.reasons for r in G.finalise(again, "line").orderBy("id").collect()] == [[], ["duplicate_gold_set"]]


def test_fold_against_a_loop(spark, sf):
    from cairn.functions.text import normal_question
    from cairn.plans.production import _questions

    rows = G.finalise_reasons(*_questions(spark, sf))
    keys = rows.select("id", "qtype", "gold_chunk_ids", "reasons", normal_question(F.col("question")).alias("k")).orderBy("id").collect()
    seen_q, seen_g, want = set(), set(), {}
    for r in keys:
        why, g = list(r.reasons), (r.qtype, tuple(sorted(r.gold_chunk_ids)))
        if not why:
            why = ["duplicate_question"] if r.k in seen_q else ["duplicate_gold_set"] if g in seen_g else []
            if not why:
                seen_q.add(r.k)
                seen_g.add(g)
        want[r.id] = why
    assert {r.id: r.reasons for r in G.finalise(rows, "id").select("id", "reasons").collect()} == want


def test_fold_in_rounds(spark, monkeypatch):
    """Chains (each edge waits for the one before), stars and random edges: the rounds accept what a loop does, and no task folds much more than it may."""
    draw = random.Random(5)
    shapes = {
        "chain": [((i + 1) // 2, i // 2) for i in range(60)], "distinct": [(i, i) for i in range(60)], "star": [(0, i) for i in range(60)],
        "random": sorted({(draw.randrange(25), draw.randrange(25)) for _ in range(150)}, key=lambda _: draw.random()),
    }
    folded, fold = [], G._fold
    monkeypatch.setattr(G, "_fold", lambda edges: folded.append(edges.count()) or fold(edges))
    for name, pairs in shapes.items():
        texts, golds, want = set(), set(), set()
        for i, (q, g) in enumerate(pairs):
            if q not in texts and g not in golds:
                texts.add(q), golds.add(g), want.add(f"n{i:03}")
        rows = [(str(q).encode(), str(g).encode(), i, f"n{i:03}") for i, (q, g) in enumerate(pairs)]
        got, n = G.accepted(spark.createDataFrame(rows, "q binary, g binary, o int, id string").repartition(3), most=12)
        assert {r.id for r in got.collect()} == want and n == len(want), name
    assert max(folded) <= 24


def test_manifest_and_shares(spark):
    two = {"qtype": "multi_hop", "gold_chunk_ids": ["a", "b"], "gold_paper_ids": ["p", "q"]}
    done = G.finalise(gated(spark, {}, two | {"question": "Compare the two of them"}, {"status": "rejected"}), "line")
    m = G.manifest(done, "g").first()
    assert m.by_type == {"simple": 1, "multi_hop": 1} and m.rejected_by_reason == {"not_accepted": 1} and m.rejected_total == 1 and m.stability_self_judged_questions == 2
    s = G.paper_shares(done.where("final")).first()
    assert (s.n_questions, s.n_distinct_papers, s.max_paper_share, s.max_paper_share_first_paper) == (2, 2, 1.0, 1.0)
    counts = done.where("final").groupBy("qtype").agg(F.count("*").alias("n"))
    assert {r.qtype: r.ok for r in G.check_minimums(counts, "simple=1, chain=2").collect()} == {"simple": True, "chain": False}


def test_review_letters(spark):
    c = spark.createDataFrame([(1, "candidate"), (2, "candidate"), (3, "candidate")], "line int, status string")
    assert [r.status for r in G.apply_review(c, "AR", "line").orderBy("line").collect()] == ["accepted", "rejected", "candidate"]
    for letters in ("AX", "AAAA"):
        with pytest.raises(ValueError):
            G.apply_review(c, letters, "line")
