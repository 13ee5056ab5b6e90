"""Gates of benchmark production: generated questions, judge verdicts, stability, finalising, review and manifest.

Reasons accumulate in a fixed order where a question is judged or finalised, and the first wins where it is generated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NOT_WORD, greedy_object, normal_question, review_mode, wait_seconds, without_comments
from ..sources.jsonl import QUESTION
from ..sources.shared import remove, shared_folder
from .runlog import DEFAULT_WAIT

# Least gold chunks by type, types that need two papers, names that are no provenance.
MIN_GOLD = {"simple": 1, "multi_hop": 2, "conflicting": 2, "temporal": 2, "chain": 2}
CROSS_PAPER = ("multi_hop", "conflicting", "temporal")
NO_MODEL = ("", "unknown", "config-default")
COMPARISON = r"(?i)\b(compare|comparison|better|best|outperform|versus|vs\.?|agree|disagree|differ)\b"
FOLD = 1 << 17  # questions that one task goes through in order
VERDICT = (
    "answer_supported boolean, needs_all_passages boolean, unsupported_claims array<string>, passage_1_contribution string, passage_2_contribution string, "
    "joint_reason string, problems string, quantities_comparable boolean, same_quantity boolean"
)


def _reasons(*tests: tuple[Column, str]) -> Column:
    """Names of the tests that hold, in order; an unknown test does not hold."""
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in tests]), lambda r: r.isNotNull())


def _blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s", "") == "", F.lit(True))


def _not_true(flag: Column) -> Column:
    return ~F.coalesce(flag, F.lit(False))


def judge_reply(reply: Column) -> Column:
    """The reply's JSON object as a struct, // comments taken out; null where none can be read or it is empty."""
    text = without_comments(greedy_object(reply))
    usable = F.try_parse_json(text).isNotNull() & (F.size(F.json_object_keys(text)) > 0)
    return F.when(usable, F.from_json(text, VERDICT))


def verdict_reasons(v: Column, qtype: Column) -> Column:
    """Why a judged question fails, in order; empty where it passes."""
    several = qtype != "simple"
    judged = _reasons(
        (_not_true(v["answer_supported"]), "answer_not_supported"),
        (several & _not_true(v["needs_all_passages"]), "not_all_passages_needed"),
        (several & (_blank(v["passage_1_contribution"]) | _blank(v["passage_2_contribution"])), "missing_passage_contributions"),
        (several & _blank(v["joint_reason"]), "missing_joint_reason"),
        (v["quantities_comparable"] == False, "quantities_not_comparable"),  # noqa: E712
        (qtype.isin("temporal", "conflicting") & _not_true(v["same_quantity"]), "different_quantity"),
    )
    return F.when(v.isNull(), F.array(F.lit("judge_unparseable"))).otherwise(judged)


def qa_parse(reply: Column) -> Column:
    """question and answer of a generator's reply; null where they are missing, short or refused."""
    read = F.from_json(greedy_object(reply), "question string, reference_answer string")
    question, answer = F.trim(F.coalesce(read["question"], F.lit(""))), F.trim(F.coalesce(read["reference_answer"], F.lit("")))
    good = (F.length(question) >= 15) & ~F.startswith(F.upper(question), F.lit("NONE")) & (answer != "")
    return F.when(good, F.struct(question.alias("question"), answer.alias("answer")))


def structural_reason(qtype: Column, question: Column, first: Column, second: Column, joint: Column, same_quantity: Column) -> Column:
    """Why a generated question's structure fails, first reason first; simple questions have none."""
    role = lambda c: F.trim(F.regexp_replace(F.lower(c), NOT_WORD, " "))
    reason = F.when(qtype == "simple", F.lit(None).cast("string")).when(_blank(first) | _blank(second) | _blank(joint), "missing_structured_evidence")
    reason = reason.when(role(first) == role(second), "non_distinct_passage_contributions")
    reason = reason.when((qtype == "multi_hop") & question.rlike(COMPARISON) & _not_true(same_quantity), "comparison_without_shared_quantity")
    return reason.when(qtype.isin("temporal", "conflicting") & _not_true(same_quantity), "different_quantity")


def simple_reason(question: Column) -> Column:
    return F.when(question.rlike(r"(?i)\b(passages?|texts?)\b"), "simple_mentions_source").when(question.rlike(r"(?i)\bwhich reference\b"), "citation_trivia")


def prompt_passages(passages: Column, most: int, head: str = "[%d] ") -> Column:
    """Passages as a prompt shows them: numbered, each cut to its first ``most`` characters (1200 for a generator, 1500 for a judge)."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.format_string(head, i + 1), F.substring(p, 1, most))), "\n\n")


def replayed(attempts: DataFrame) -> DataFrame:
    """A generation run replayed from cached replies. attempts (qtype, paired, generated, judged) -> plus question, answer and
    ``outcomes``, the counters that the attempt raises in their order.

    A pair-type attempt without a partner ends as ``no_valid_pair`` or ``no_valid_chain_pair``; an unusable reply as
    ``generator_returned_none``; a structural or simple-question gate under its own name; a null judge reply means that the judge
    gave none. Verdict reasons follow, or ``passed``. Every attempt counts as such, survivors also as ``survived``.
    """
    qa, qtype = qa_parse(F.col("generated")), F.col("qtype")
    read = F.from_json(greedy_object(F.col("generated")), "passage_1_contribution string, passage_2_contribution string, joint_reason string, same_quantity boolean")
    rows = attempts.withColumn("_qa", qa).withColumn("_g", read).withColumn("_why", verdict_reasons(judge_reply(F.col("judged")), qtype))
    structural = structural_reason(qtype, F.col("_qa.question"), F.col("_g.passage_1_contribution"), F.col("_g.passage_2_contribution"), F.col("_g.joint_reason"), F.col("_g.same_quantity"))
    one = lambda name: F.array(F.lit(name))
    early = F.when((qtype != "simple") & ~F.col("paired"), F.when(qtype == "chain", one("no_valid_chain_pair")).otherwise(one("no_valid_pair")))
    early = early.when(F.col("_qa").isNull(), one("generator_returned_none"))
    early = early.when((qtype == "simple") & simple_reason(F.col("_qa.question")).isNotNull(), F.array(simple_reason(F.col("_qa.question"))))
    early = early.when(structural.isNotNull(), F.array(structural)).when(F.col("judged").isNull(), F.array().cast("array<string>"))
    met = rows.withColumn("_out", F.coalesce(early, F.when(F.size("_why") > 0, F.col("_why")).otherwise(one("passed")))).withColumn("survived", F.array_contains("_out", "passed"))
    tried = F.array(F.concat(F.lit("attempt:"), qtype))
    outcomes = F.concat("_out", tried, F.when(F.col("survived"), F.array(F.concat(F.lit("survived:"), qtype))).otherwise(F.array().cast("array<string>")))
    return met.withColumn("outcomes", outcomes).withColumn("question", F.col("_qa.question")).withColumn("answer", F.col("_qa.answer")).drop("_qa", "_g", "_why", "_out")


def validation_json(verdict: Column, ok: Column, reasons: Column, judge_model: str, generator_model: str) -> Column:
    """The provenance that a saved question carries: verdict, its reasons, and both models by name."""
    return F.to_json(F.struct(ok.alias("ok"), reasons.alias("reasons"), verdict.alias("verdict"), F.lit(judge_model).alias("judge_model"), F.lit(generator_model).alias("generator_model")))


def audited(questions: DataFrame, done: DataFrame, replies: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """An audit that goes on where it stopped, replayed. questions (id, qtype, ``order``), done (id), replies (id, reply, quota: the
    provider's message where it refused) -> (new rows id, qtype, ok, reasons; one row already_done, new, total, stopped_before,
    suggested_wait). The first refusal in the order stops the audit; what comes after it waits for the next run."""
    todo = questions.join(done.select("id").distinct(), "id", "left_anti").join(replies.select("id", "reply", "quota"), "id", "left")
    stop = todo.where(F.col("quota").isNotNull()).agg(F.min(F.struct(F.col(order).alias("o"), F.col("id").alias("id"), F.col("quota").alias("q"))).alias("s"))
    before = todo.crossJoin(F.broadcast(stop)).where(F.col("s").isNull() | (F.col(order) < F.col("s.o")))  # one row
    fresh = before.withColumn("reasons", verdict_reasons(judge_reply(F.col("reply")), F.col("qtype"))).select("id", "qtype", (F.size("reasons") == 0).alias("ok"), "reasons")
    known = questions.select("id").join(done.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("already_done"))
    sums = known.crossJoin(fresh.agg(F.count("*").alias("new"))).crossJoin(questions.agg(F.count("*").alias("total"))).crossJoin(stop)  # one-row tables
    wait = F.coalesce(wait_seconds(F.col("s.q")), F.when(F.col("s").isNotNull(), F.lit(DEFAULT_WAIT)))
    return fresh, sums.select("already_done", "new", "total", F.col("s.id").alias("stopped_before"), wait.alias("suggested_wait"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row: judged and passed questions."""
    return audit.agg(F.count("*").alias("judged"), F.count_if("ok").alias("passed"))


def flagged(audit: DataFrame) -> DataFrame:
    return audit.where(~F.col("ok"))


def generation_run(questions: DataFrame, run: int = 0) -> DataFrame:
    """(id, run, ok): the verdict noted when a question was made, as one more judge run; questions without one have no row."""
    return questions.select("id", F.lit(run).alias("run"), provenance(F.col("validation"))["ok"].alias("ok")).where(F.col("ok").isNotNull())


def stability_class(verdicts: Column) -> Column:
    """stable_pass, stable_fail or unstable; null without verdicts."""
    some = F.size(verdicts) > 0
    return F.when(some & F.forall(verdicts, lambda v: v), "stable_pass").when(some & ~F.exists(verdicts, lambda v: v), "stable_fail").when(some, "unstable")


def judged_in_every_run(runs: DataFrame) -> DataFrame:
    """runs (run, id, ok) -> (id, verdicts by run) of the ids that all runs judged."""
    total = runs.agg(F.count_distinct("run").alias("n_runs"))
    ordered = F.sort_array(F.collect_list(F.struct("run", "ok")))
    whole = runs.groupBy("id").agg(F.count_distinct("run").alias("n"), ordered.alias("rows"))
    return whole.join(F.broadcast(total), F.col("n") == F.col("n_runs")).select("id", F.transform("rows", lambda r: r["ok"]).alias("verdicts"))  # one row


def pairwise_agreement(verdicts: DataFrame) -> DataFrame:
    """One row: agreeing and all pairs of runs over all questions, and their ratio (null without pairs)."""
    n, t = F.size("verdicts").cast("long"), F.size(F.filter("verdicts", lambda v: v)).cast("long")
    two = lambda k: F.floor(k * (k - 1) / 2)
    sums = verdicts.agg(F.coalesce(F.sum(two(t) + two(n - t)), F.lit(0)).alias("agree"), F.coalesce(F.sum(two(n)), F.lit(0)).alias("pairs"))
    return sums.withColumn("pairwise_agreement", F.try_divide(F.col("agree"), F.col("pairs").cast("double")))


def audit_histogram(audit: DataFrame) -> DataFrame:
    """audit (id, ok, reasons) -> (reason, n) over failures."""
    return audit.where(~F.col("ok")).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def provenance(validation: Column) -> Column:
    """Models and verdict noted in a question's validation JSON; nulls where it can't be read."""
    return F.from_json(validation, "judge_model string, generator_model string, ok boolean")


def finalise_reasons(q: DataFrame, stability: DataFrame, require_runs: int = 3, require_human: bool = True, stability_model: str | None = None) -> DataFrame:
    """questions plus ``reasons``: every gate of the final benchmark that a question fails, in order."""
    met = q.join(stability.select("id", "verdicts", stability_class(F.col("verdicts")).alias("_class")), "id", "left")
    v = provenance(F.col("validation"))
    none, known = F.col("verdicts").isNull(), F.col("qtype").isin(*MIN_GOLD)
    papers = F.size(F.array_distinct("gold_paper_ids"))
    least = F.coalesce(*[F.when(F.col("qtype") == k, F.lit(n)) for k, n in MIN_GOLD.items()])
    tests = [
        (F.col("status") != "accepted", "not_accepted"), (F.col("split") != "test", "not_test_split"),
        (F.lit(require_human) & (F.coalesce(review_mode(F.col("notes")), F.lit("")) != "human"), "no_human_review"),
        (none, "no_stability_record"), (~none & (F.size("verdicts") < require_runs), "too_few_judge_runs"),
        (F.col("_class") == "unstable", "judge_unstable"), (F.col("_class") == "stable_fail", "judge_stable_fail"),
        (~known, "unknown_qtype"), (known & (F.size("gold_chunk_ids") < least), "too_few_gold_chunks"),
        (F.col("qtype").isin(*CROSS_PAPER) & (papers < 2), "needs_two_papers"), ((F.col("qtype") == "chain") & (papers != 1), "chain_must_be_single_paper"),
        (F.coalesce(v["judge_model"], F.lit("")).isin(*NO_MODEL), "no_judge_model_recorded"),
        (F.lit(stability_model is not None) & (v["generator_model"] == F.lit(stability_model)), "stability_self_judged"),
    ]
    return met.withColumn("reasons", _reasons(*tests)).drop("_class", "verdicts")


def _fold(edges: DataFrame) -> DataFrame:
    """The accepted ones of edges (q, g, o, id), in one task: those of which no accepted edge before them has the q or the g."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: set[bytes] = set()
        golds: set[bytes] = set()
        for batch in batches:
            kept: list[bool] = []
            for q, g in zip(batch.column("q").to_pylist(), batch.column("g").to_pylist(), strict=True):
                kept.append(q not in texts and g not in golds)
                if kept[-1]:
                    texts.add(q)
                    golds.add(g)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return edges.repartition(1).sortWithinPartitions("o", "id").mapInArrow(fold, edges.schema)


def accepted(edges: DataFrame, most: int = FOLD) -> tuple[DataFrame, int]:
    """edges (q, g, o, id): in the order of (o, id) an edge is accepted unless its q or its g is taken -> the accepted ones, as
    written in the shared folder, and their number; ids are unique and no pair (q, g) comes twice.

    In a round every edge that is the first both of its q and of its g is accepted, as nothing before it can take them, and the
    edges that share a key with accepted ones go. Where a round takes less than half of the edges (chains, in which each waits
    for the one before), the foremost edges, some ``most``, are also folded one after another. The last ``most`` are folded in one
    task, so no task reads more, however many edges there are; a single chain through all of them takes edges / ``most`` rounds.
    """
    spark = edges.sparkSession
    path, cols = shared_folder(spark, "finalise"), ("q", "g", "o", "id")
    edges.select(*cols).write.parquet(f"{path}/left-0")
    before = step = 0
    while True:
        left = spark.read.parquet(f"{path}/left-{step}")
        n, out = left.count(), f"{path}/accepted/step={step}"
        if n <= most:
            _fold(left).write.parquet(out)
            break
        of_text, of_gold = (left.groupBy(c).agg(F.min(F.struct("o", "id")).alias("m")) for c in ("q", "g"))
        now = of_text.join(of_gold, "m").select("q", "g", "m.o", "m.id")
        if 2 * n > before > 0:
            foremost = left.repartitionByRange(-(-n // most), "o", "id").where(F.spark_partition_id() == 0)
            now = now.unionByName(_fold(foremost)).dropDuplicates(["id"])
        now.write.parquet(out)
        new = spark.read.parquet(out)
        new = F.broadcast(new) if new.count() <= most else new
        left.join(new.select("q"), "q", "left_anti").join(new.select("g"), "g", "left_anti").select(*cols).write.parquet(f"{path}/left-{step + 1}")
        remove(spark, f"{path}/left-{step}")
        before, step = n, step + 1
    found = spark.read.parquet(f"{path}/accepted").select(*cols)
    return found, found.count()


def finalise(gated: DataFrame, order: str) -> DataFrame:
    """Adds duplicate reasons: in file order the first question with a key wins, and only accepted questions register keys.

    Two keys (question text; type with gold set) make this a fold over what passed the gates. Only the first question of a pair of
    keys can win, so the fold is over distinct pairs of digests, by rounds (``accepted``); nothing else of a question travels
    there. A question whose text an accepted one before it has is a duplicate by its text, any other that was not accepted by
    its gold set.
    """
    digest = lambda c: F.unhex(F.coalesce(F.md5(c), F.lit("")))
    gold = F.concat_ws("\u0001", F.concat(F.lit("t:"), "qtype"), F.array_sort("gold_chunk_ids"))
    keyed = gated.withColumn("_q", digest(normal_question(F.col("question")))).withColumn("_o", F.struct(F.col(order).alias("o"), F.col("id").alias("id")))
    rows = keyed.where(F.size("reasons") == 0).select(F.col("_q").alias("q"), digest(gold).alias("g"), "_o")
    winners, n = accepted(rows.groupBy("q", "g").agg(F.min("_o").alias("m")).select("q", "g", "m.o", "m.id"))
    winners = winners.select(F.col("q").alias("_q"), F.struct("o", "id").alias("_w"))
    met = keyed.join(F.broadcast(winners) if n <= FOLD else winners, "_q", "left")
    why = F.when(F.col("_w.id") == F.col("id"), None).when(F.col("_w") < F.col("_o"), "duplicate_question").otherwise("duplicate_gold_set")
    done = met.withColumn("reasons", F.when((F.size("reasons") == 0) & why.isNotNull(), F.array(why)).otherwise(F.col("reasons")))
    return done.drop("_q", "_o", "_w").withColumn("final", F.size("reasons") == 0)


def paper_shares(final: DataFrame) -> DataFrame:
    """One row: questions, distinct papers, the largest share of questions that involve one paper, and that by first paper (3 digits)."""
    n = final.agg(F.count("*").alias("n_questions"))
    by = lambda rows, name: rows.groupBy("p").agg(F.count("*").alias("c")).agg(F.count("*").alias(f"papers_{name}"), F.max("c").alias(f"most_{name}"))
    member = by(final.select(F.explode(F.array_distinct("gold_paper_ids")).alias("p")), "any")
    first = by(final.select(F.coalesce(F.get("gold_paper_ids", F.lit(0)), F.lit("?")).alias("p")), "first")
    share = lambda c: F.round(F.try_divide(F.col(c), F.col("n_questions").cast("double")), 3)
    met = n.crossJoin(member).crossJoin(first)  # three one-row tables
    return met.select("n_questions", F.col("papers_any").alias("n_distinct_papers"), share("most_any").alias("max_paper_share"), share("most_first").alias("max_paper_share_first_paper"))


def manifest(finalised: DataFrame, stability_model: str | None = None) -> DataFrame:
    """One row with the counts that pin a benchmark: by type, by review mode, rejections by reason, models, self-judged questions."""
    final, v = finalised.where("final"), provenance(F.col("validation"))
    counts = lambda rows, key, name: rows.groupBy(key.alias("k")).agg(F.count("*").alias("c")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "c")))).alias(name))
    row = counts(final, F.col("qtype"), "by_type").crossJoin(counts(final, F.coalesce(review_mode(F.col("notes")), F.lit("none")), "review_modes"))
    row = row.crossJoin(counts(finalised.where("not final").select(F.explode("reasons").alias("r")), F.col("r"), "rejected_by_reason"))
    named = final.withColumn("v", v).withColumn("gm", F.coalesce("v.generator_model", F.lit("?"))).withColumn("jm", F.coalesce("v.judge_model", F.lit("?")))
    models = named.agg(
        F.array_sort(F.collect_set("gm")).alias("generator_models"), F.array_sort(F.collect_set("jm")).alias("judge_models"), F.count_if(F.col("gm") == F.col("jm")).alias("self_judged_questions"),
        F.count_if(F.col("gm") == F.lit(stability_model)).alias("stability_self_judged_questions"),
    )
    return row.crossJoin(models).crossJoin(finalised.agg(F.count_if(~F.col("final")).alias("rejected_total")))


def check_minimums(counts: DataFrame, spec: str) -> DataFrame:
    """counts (qtype, n), spec 'simple=15,chain=3' -> (qtype, need, n, ok)."""
    spark = counts.sparkSession
    wanted = spark.range(1).select(F.explode(F.str_to_map(F.lit(spec), F.lit(","), F.lit("="))).alias("qtype", "need")).where("qtype <> ''")
    met = wanted.select(F.trim("qtype").alias("qtype"), F.trim("need").cast("long").alias("need")).join(counts, "qtype", "left")
    return met.select("qtype", "need", F.coalesce("n", F.lit(0)).alias("n")).withColumn("ok", F.col("n") >= F.col("need"))


def self_judge_conflicts(q: DataFrame, judge_model: str) -> DataFrame:
    return q.where(provenance(F.col("validation"))["generator_model"] == judge_model).select("id")


def apply_review(candidates: DataFrame, letters: str, order: str) -> DataFrame:
    """Letters A and R, by place, over the candidates in order; more letters than candidates or others are an error."""
    if set(letters) - {"A", "R"}:
        raise ValueError("a review is written with the letters A and R")
    placed = candidates.withColumn("_n", F.row_number().over(W.orderBy(order)))  # one reviewer's list
    if placed.count() < len(letters):
        raise ValueError("more letters than candidates")
    letter = F.substring(F.lit(letters), F.col("_n"), F.lit(1))
    return placed.withColumn("status", F.when(letter == "A", "accepted").when(letter == "R", "rejected").otherwise(F.col("status"))).drop("_n")


def empty_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUESTION)
