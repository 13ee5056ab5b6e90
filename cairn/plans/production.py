"""Queries of benchmark production, run logs and integrity, each with its DuckDB SQL. Events stand for questions and runs,
labels for judge runs, conversations for model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates, integrity, runlog
from . import views as V
from .registry import query, sql_list

R6 = lambda c: F.round(c, 6)


def _pick(items, n):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (n + 1).cast("int"))


_JUDGE = (
    'ok {"answer_supported": true, "needs_all_passages": true, "passage_1_contribution": "a", "passage_2_contribution": "b", "joint_reason": "c", "same_quantity": true}',
    '{"answer_supported": false, "needs_all_passages": false, "passage_1_contribution": " ", "passage_2_contribution": "b", "joint_reason": "", "quantities_comparable": false}',
    "no json", '{"answer_supported": true, // yes\n "needs_all_passages": true, "passage_1_contribution": "a", "passage_2_contribution": "b", "joint_reason": "c", "same_quantity": false}',
    "{}", "[1, 2]", '{"answer_supported": "true"}',
)
_KIND_SQL = "['simple', 'multi_hop', 'conflicting', 'temporal', 'chain'][event_id % 5 + 1]"
_KIND = lambda: _pick(V.QTYPES, F.col("event_id") % 5)


_VERDICT_SQL = rf"""jt AS (SELECT *, regexp_replace(regexp_extract(reply, '(?s)\{{.*\}}'), '//[^\n]*', '', 'g') AS t FROM said), js AS (SELECT *, CASE WHEN json_valid(t) AND len(json_keys(t)) > 0 THEN t::JSON END AS j FROM jt),
  vs AS (SELECT *, CASE WHEN j IS NULL THEN ['judge_unparseable'] ELSE list_filter([CASE WHEN coalesce(json_extract(j, '$.answer_supported')::VARCHAR, '') <> 'true' THEN 'answer_not_supported' END,
    CASE WHEN qtype <> 'simple' AND coalesce(json_extract(j, '$.needs_all_passages')::VARCHAR, '') <> 'true' THEN 'not_all_passages_needed' END,
    CASE WHEN qtype <> 'simple' AND (trim(coalesce(json_extract_string(j, '$.passage_1_contribution'), '')) = '' OR trim(coalesce(json_extract_string(j, '$.passage_2_contribution'), '')) = '') THEN 'missing_passage_contributions' END,
    CASE WHEN qtype <> 'simple' AND trim(coalesce(json_extract_string(j, '$.joint_reason'), '')) = '' THEN 'missing_joint_reason' END,
    CASE WHEN json_extract(j, '$.quantities_comparable')::VARCHAR = 'false' THEN 'quantities_not_comparable' END,
    CASE WHEN qtype IN ('temporal', 'conflicting') AND coalesce(json_extract(j, '$.same_quantity')::VARCHAR, '') <> 'true' THEN 'different_quantity' END], lambda x: x IS NOT NULL) END AS reasons FROM js)"""
_SAID_SQL = rf"""said AS (SELECT event_id, {_KIND_SQL} AS qtype, {sql_list(_JUDGE)}[event_id % {len(_JUDGE)} + 1] AS reply FROM events)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").select(F.col("event_id").alias("id"), _pick(_JUDGE, F.col("event_id") % len(_JUDGE)).alias("reply"), _KIND().alias("qtype"))


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).withColumn("reasons", gates.verdict_reasons(gates.judge_reply(F.col("reply")), F.col("qtype"))).withColumn("ok", F.size("reasons") == 0)


@query(rf"""WITH {_SAID_SQL}, {_VERDICT_SQL} SELECT event_id, array_to_string(reasons, ',') AS reasons FROM vs""")
def verdict_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).select(F.col("id").alias("event_id"), F.array_join("reasons", ",").alias("reasons"))


_RUNS_SQL = r"""runs AS (SELECT doc_id AS id, 1 AS run, quality = 1 AS ok FROM labels UNION ALL SELECT doc_id, 2, toxic = 0 FROM labels UNION ALL SELECT doc_id, 3, doc_id % 4 <> 0 FROM labels WHERE doc_id % 9 <> 0),
  v AS (SELECT id, list(ok ORDER BY run) AS verdicts FROM runs GROUP BY id HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM runs)),
  c AS (SELECT *, CASE WHEN list_bool_and(verdicts) THEN 'stable_pass' WHEN NOT list_bool_or(verdicts) THEN 'stable_fail' ELSE 'unstable' END AS class FROM v)"""


def _judge_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = V.table(spark, sf, "labels")
    run = lambda n, ok, rows=r: rows.select(F.col("doc_id").alias("id"), F.lit(n).alias("run"), ok.alias("ok"))
    return run(1, F.col("quality") == 1).unionByName(run(2, F.col("toxic") == 0)).unionByName(run(3, F.col("doc_id") % 4 != 0, r.where("doc_id % 9 <> 0")))


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return gates.judged_in_every_run(_judge_runs(spark, sf))


@query(rf"WITH {_RUNS_SQL} SELECT id, array_to_string(list_transform(verdicts, lambda x: x::INT::VARCHAR), '') AS verdicts, class FROM c")
def stability_classes(spark: SparkSession, sf: str) -> DataFrame:
    bits = F.array_join(F.transform("verdicts", lambda v: v.cast("int").cast("string")), "")
    return _verdicts(spark, sf).select("id", bits.alias("verdicts"), gates.stability_class(F.col("verdicts")).alias("class"))


@query(rf"""WITH {_RUNS_SQL}, t AS (SELECT len(list_filter(verdicts, lambda x: x)) AS t, len(verdicts) AS n FROM c)
  SELECT sum(t * (t - 1) // 2 + (n - t) * (n - t - 1) // 2)::BIGINT AS agree, sum(n * (n - 1) // 2)::BIGINT AS pairs, round(sum(t * (t - 1) // 2 + (n - t) * (n - t - 1) // 2)::DOUBLE / sum(n * (n - 1) // 2), 6) AS pairwise_agreement FROM t""")
def pairwise_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return gates.pairwise_agreement(_verdicts(spark, sf)).withColumn("pairwise_agreement", R6("pairwise_agreement"))


@query(rf"WITH {_RUNS_SQL} SELECT ['simple', 'multi_hop', 'conflicting', 'temporal', 'chain'][id % 5 + 1] AS qtype, class, count(*) AS n FROM c GROUP BY 1, 2")
def stability_by_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = _verdicts(spark, sf).select(_pick(V.QTYPES, F.col("id") % 5).alias("qtype"), gates.stability_class(F.col("verdicts")).alias("class"))
    return rows.groupBy("qtype", "class").agg(F.count("*").alias("n"))


@query(rf"""WITH {_SAID_SQL}, {_VERDICT_SQL}, w AS (SELECT unnest(reasons) AS reason FROM vs) SELECT reason, count(*) AS n FROM w GROUP BY reason UNION ALL SELECT 'judged', count(*) FROM vs UNION ALL SELECT 'passed', count(*) FROM vs WHERE len(reasons) = 0""")
def audit_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The audit's summary: reasons over failures, and how many were judged and passed."""
    audit = _audit(spark, sf)
    sums = gates.audit_summary(audit).select(F.explode(F.create_map(F.lit("judged"), "judged", F.lit("passed"), "passed")).alias("reason", "n"))
    return gates.audit_histogram(audit).unionByName(sums)


@query(rf"""WITH {_SAID_SQL}, {_VERDICT_SQL} SELECT event_id AS id, array_to_string(reasons, ',') AS reasons FROM vs WHERE len(reasons) > 0""")
def audit_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return gates.flagged(_audit(spark, sf)).select("id", F.array_join("reasons", ",").alias("reasons"))


# An audit whose first tenth is done, and that a provider stops at the first id past half that 41 divides.
_STOPS_SQL = rf"""{_SAID_SQL}, lim AS (SELECT max(event_id) AS m FROM events), todo AS (SELECT s.*, m FROM said s, lim WHERE event_id * 10 > m), stop AS (SELECT min(event_id) AS s FROM todo WHERE event_id % 41 = 0 AND event_id * 2 > m)"""


def _audit_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = _judged(spark, sf).crossJoin(F.broadcast(V.table(spark, sf, "events").agg(F.max("event_id").alias("m"))))  # one row
    refused = (F.col("id") % 41 == 0) & (F.col("id") * 2 > F.col("m"))
    replies = q.select("id", F.when(~refused, F.col("reply")).alias("reply"), F.when(refused, "limit reached, try again in 1m2s").alias("quota"))
    return gates.audited(q.select("id", "qtype", F.col("id").alias("place")), q.where("id * 10 <= m").select("id"), replies, "place")


@query(rf"""WITH {_STOPS_SQL}, {_VERDICT_SQL.replace('FROM said', 'FROM todo')} SELECT event_id AS id, qtype, len(reasons) = 0 AS ok, array_to_string(reasons, ',') AS reasons FROM vs, stop WHERE s IS NULL OR event_id < s""")
def audit_resume(spark: SparkSession, sf: str) -> DataFrame:
    """What an audit that goes on appends before the provider stops it."""
    return _audit_run(spark, sf)[0].withColumn("reasons", F.array_join("reasons", ","))


@query(rf"""WITH {_STOPS_SQL} SELECT (SELECT count(*) FROM events) - (SELECT count(*) FROM todo) AS already_done, (SELECT count(*) FROM todo, stop WHERE s IS NULL OR event_id < s) AS new, (SELECT count(*) FROM events) AS total, s AS stopped_before, CASE WHEN s IS NOT NULL THEN 62.0::DOUBLE END AS suggested_wait FROM stop""")
def audit_stop(spark: SparkSession, sf: str) -> DataFrame:
    return _audit_run(spark, sf)[1]


_QA = ('Here: {"question": "What is the value of H0?", "reference_answer": "70"}', '{"question": "short?", "reference_answer": "x"}', '{"question": "NONE of these passages fit", "reference_answer": "x"}', '{"question": "Which value is found here?", "reference_answer": " "}', "nothing")
_QA_SQL = r"""qt AS (SELECT *, regexp_extract(generated, '(?s)\{.*\}') AS gt FROM asked_of), qj AS (SELECT *, CASE WHEN json_valid(gt) THEN gt::JSON END AS g FROM qt),
  qq AS (SELECT *, trim(coalesce(json_extract_string(g, '$.question'), '')) AS q, trim(coalesce(json_extract_string(g, '$.reference_answer'), '')) AS a FROM qj),
  qa AS (SELECT *, length(q) >= 15 AND NOT starts_with(upper(q), 'NONE') AND a <> '' AS usable FROM qq)"""


@query(rf"WITH asked_of AS (SELECT event_id, {sql_list(_QA)}[event_id % 5 + 1] AS generated FROM events), {_QA_SQL} SELECT event_id, usable, CASE WHEN usable THEN q END AS question FROM qa")
def qa_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("event_id", gates.qa_parse(_pick(_QA, F.col("event_id") % 5)).alias("qa"))
    return e.select("event_id", F.col("qa").isNotNull().alias("usable"), "qa.question")


_MADE = (
    *_QA, '{"question": "Compare the H0 of both papers?", "reference_answer": "70", "passage_1_contribution": "Gives H0.", "passage_2_contribution": "gives  h0", "joint_reason": "both"}',
    '{"question": "Compare the H0 of both papers?", "reference_answer": "70", "passage_1_contribution": "Gives H0.", "passage_2_contribution": "Gives S8", "joint_reason": "both"}',
    '{"question": "What do the papers find of H0?", "reference_answer": "70", "passage_1_contribution": "Gives H0.", "passage_2_contribution": "Gives S8", "joint_reason": "both", "same_quantity": true}',
    '{"question": "What does this passage tell us?", "reference_answer": "70"}',
)
_REPLAY_SQL = rf"""asked_of AS (SELECT event_id, {_KIND_SQL} AS qtype, event_id % 11 <> 0 AS paired, {sql_list(_MADE)}[event_id % {len(_MADE)} + 1] AS generated, CASE WHEN event_id % 13 <> 0 THEN {sql_list(_JUDGE)}[event_id % {len(_JUDGE)} + 1] END AS reply FROM events), {_QA_SQL},
  said AS (SELECT *, trim(regexp_replace(lower(coalesce(json_extract_string(g, '$.passage_1_contribution'), '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS one, trim(regexp_replace(lower(coalesce(json_extract_string(g, '$.passage_2_contribution'), '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS two,
    trim(coalesce(json_extract_string(g, '$.joint_reason'), '')) AS joint, coalesce(json_extract(g, '$.same_quantity')::VARCHAR, '') = 'true' AS same FROM qa), {_VERDICT_SQL},
  o AS (SELECT *, CASE WHEN qtype <> 'simple' AND NOT paired THEN [CASE WHEN qtype = 'chain' THEN 'no_valid_chain_pair' ELSE 'no_valid_pair' END] WHEN NOT usable THEN ['generator_returned_none']
    WHEN qtype = 'simple' AND regexp_matches(q, '(?i)\b(passages?|texts?)\b') THEN ['simple_mentions_source'] WHEN qtype = 'simple' AND regexp_matches(q, '(?i)\bwhich reference\b') THEN ['citation_trivia']
    WHEN qtype <> 'simple' AND (one = '' OR two = '' OR joint = '') THEN ['missing_structured_evidence'] WHEN qtype <> 'simple' AND one = two THEN ['non_distinct_passage_contributions']
    WHEN qtype = 'multi_hop' AND regexp_matches(q, '{gates.COMPARISON}') AND NOT same THEN ['comparison_without_shared_quantity'] WHEN qtype IN ('temporal', 'conflicting') AND NOT same THEN ['different_quantity']
    WHEN reply IS NULL THEN [] WHEN len(reasons) > 0 THEN reasons ELSE ['passed'] END AS result FROM vs),
  w AS (SELECT *, list_concat(result, ['attempt:' || qtype], CASE WHEN list_contains(result, 'passed') THEN ['survived:' || qtype] ELSE [] END) AS outcomes FROM o)"""


@query(rf"""WITH {_REPLAY_SQL}, c AS (SELECT unnest(outcomes) AS counter FROM w) SELECT counter, count(*) AS n FROM c GROUP BY counter""")
def generation_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of a generation run whose replies of generator and judge are cached."""
    return _replay(spark, sf).select(F.explode("outcomes").alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def _replay(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    judged = F.when(i % 13 != 0, _pick(_JUDGE, i % len(_JUDGE)))
    return gates.replayed(V.table(spark, sf, "events").select("event_id", _KIND().alias("qtype"), (i % 11 != 0).alias("paired"), _pick(_MADE, i % len(_MADE)).alias("generated"), judged.alias("judged")))


@query(rf"""WITH {_REPLAY_SQL} SELECT event_id, qtype || '-' || substr(sha1(q), 1, 8) AS question_id, q AS question, a AS answer FROM w WHERE list_contains(result, 'passed')""")
def generated_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The questions that survive the replay, under their ids."""
    return _replay(spark, sf).where("survived").select("event_id", T.question_id(F.col("qtype"), F.col("question")).alias("question_id"), "question", "answer")


@query(r"""SELECT doc_id, md5('[1] ' || substr(coalesce(text, ''), 1, 1500) || chr(10) || chr(10) || '[2] ' || source) AS digest FROM documents""")
def prompt_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The passages of a judge's prompt, cut to 1500 characters each as the prompt's format is."""
    made = gates.prompt_passages(F.array(F.coalesce("text", F.lit("")), F.col("source")), 1500)
    return V.table(spark, sf, "documents").select("doc_id", F.md5(made.cast("binary")).alias("digest"))


_ASKED = ("Compare the two estimates of H0.", "What do both papers find?", "Which reference reports the value?", "What does the passage say?")


@query(rf"""WITH e AS (SELECT event_id, {_KIND_SQL} AS qtype, {sql_list(_ASKED)}[event_id % 4 + 1] AS q, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'Gives H0.' END AS one, CASE WHEN event_id % 3 = 0 THEN 'gives  h0' ELSE 'Gives S8' END AS two, event_id % 2 = 0 AS same FROM events)
  SELECT event_id, CASE WHEN qtype = 'simple' THEN NULL WHEN trim(one) = '' THEN 'missing_structured_evidence' WHEN trim(regexp_replace(lower(one), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) = trim(regexp_replace(lower(two), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) THEN 'non_distinct_passage_contributions'
    WHEN qtype = 'multi_hop' AND regexp_matches(q, '{gates.COMPARISON}') AND NOT same THEN 'comparison_without_shared_quantity' WHEN qtype IN ('temporal', 'conflicting') AND NOT same THEN 'different_quantity' END AS structural,
    CASE WHEN regexp_matches(q, '(?i)\b(passages?|texts?)\b') THEN 'simple_mentions_source' WHEN regexp_matches(q, '(?i)\bwhich reference\b') THEN 'citation_trivia' END AS simple FROM e""")
def structural_gates(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    e = V.table(spark, sf, "events").select(i, _KIND().alias("qtype"), _pick(_ASKED, i % 4).alias("q"), F.when(i % 7 == 0, " ").otherwise("Gives H0.").alias("one"), F.when(i % 3 == 0, "gives  h0").otherwise("Gives S8").alias("two"), (i % 2 == 0).alias("same"))
    why = gates.structural_reason(F.col("qtype"), F.col("q"), F.col("one"), F.col("two"), F.lit("both"), F.col("same"))
    return e.select("event_id", why.alias("structural"), gates.simple_reason(F.col("q")).alias("simple"))


_Q_SQL = rf"""q AS (SELECT event_id AS id, event_id, 'Question no. ' || (event_id // 3 % 500) || CASE WHEN event_id % 2 = 0 THEN '?' ELSE ' !' END AS question, {_KIND_SQL} AS qtype,
    CASE WHEN event_id % 5 = 0 THEN ['c' || (event_id % 97)] ELSE ['c' || (event_id % 97), 'c' || (event_id % 89 + 100)] END AS gold, CASE WHEN event_id % 5 = 4 THEN ['p1', 'p1'] ELSE ['p' || (event_id % 11), 'p' || (event_id % 7 + 11)] END AS papers,
    CASE WHEN event_id % 19 = 0 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN event_id % 23 = 0 THEN 'train' ELSE 'test' END AS split, CASE WHEN event_id % 17 = 0 THEN 'seen review:llm' ELSE 'review:human late' END AS notes,
    CASE event_id % 29 WHEN 0 THEN NULL WHEN 1 THEN [true, true] WHEN 2 THEN [true, false, true] WHEN 3 THEN [false, false, false] ELSE [true, true, true] END AS verdicts,
    CASE event_id % 31 WHEN 0 THEN '{{"judge_model": "unknown"}}' WHEN 1 THEN 'broken' ELSE '{{"judge_model": "j", "generator_model": "g"}}' END AS validation, event_id % 31 AS vk FROM events),
  r AS (SELECT *, list_filter([CASE WHEN status <> 'accepted' THEN 'not_accepted' END, CASE WHEN split <> 'test' THEN 'not_test_split' END, CASE WHEN notes LIKE '%review:llm%' THEN 'no_human_review' END,
    CASE WHEN verdicts IS NULL THEN 'no_stability_record' END, CASE WHEN len(verdicts) < 3 THEN 'too_few_judge_runs' END, CASE WHEN event_id % 29 = 2 THEN 'judge_unstable' END, CASE WHEN event_id % 29 = 3 THEN 'judge_stable_fail' END,
    CASE WHEN len(gold) < CASE WHEN qtype = 'simple' THEN 1 ELSE 2 END THEN 'too_few_gold_chunks' END, CASE WHEN qtype IN ('multi_hop', 'conflicting', 'temporal') AND len(list_distinct(papers)) < 2 THEN 'needs_two_papers' END,
    CASE WHEN qtype = 'chain' AND len(list_distinct(papers)) <> 1 THEN 'chain_must_be_single_paper' END, CASE WHEN vk IN (0, 1) THEN 'no_judge_model_recorded' END], lambda x: x IS NOT NULL) AS reasons FROM q)"""


def _questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("event_id")
    c = lambda n, of=0: F.concat(F.lit("c"), n + of)
    p = lambda n, of=0: F.concat(F.lit("p"), n + of)
    q = V.table(spark, sf, "events").select(
        i.alias("id"), F.concat(F.lit("Question no. "), F.expr("event_id div 3") % 500, F.when(i % 2 == 0, "?").otherwise(" !")).alias("question"), _KIND().alias("qtype"),
        F.when(i % 5 == 0, F.array(c(i % 97))).otherwise(F.array(c(i % 97), c(i % 89, 100))).alias("gold_chunk_ids"),
        F.when(i % 5 == 4, F.array(F.lit("p1"), F.lit("p1"))).otherwise(F.array(p(i % 11), p(i % 7, 11))).alias("gold_paper_ids"),
        F.when(i % 19 == 0, "rejected").otherwise("accepted").alias("status"), F.when(i % 23 == 0, "train").otherwise("test").alias("split"),
        F.when(i % 17 == 0, "seen review:llm").otherwise("review:human late").alias("notes"),
        F.when(i % 31 == 0, '{"judge_model": "unknown"}').when(i % 31 == 1, "broken").otherwise('{"judge_model": "j", "generator_model": "g"}').alias("validation"),
    )
    runs = lambda *v: F.array(*[F.lit(x) for x in v])
    v = F.when(i % 29 == 1, runs(True, True)).when(i % 29 == 2, runs(True, False, True)).when(i % 29 == 3, runs(False, False, False)).otherwise(runs(True, True, True))
    return q, V.table(spark, sf, "events").where(i % 29 != 0).select(i.alias("id"), v.alias("verdicts"))


@query(rf"WITH {_Q_SQL} SELECT id, array_to_string(reasons, ',') AS reasons FROM r")
def finalize_gates(spark: SparkSession, sf: str) -> DataFrame:
    return gates.finalise_reasons(*_questions(spark, sf)).select("id", F.array_join("reasons", ",").alias("reasons"))


_FINAL_SQL = rf"""{_Q_SQL},
  k AS MATERIALIZED (SELECT id, trim(regexp_replace(lower(question), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS kq, qtype || ':' || array_to_string(list_sort(gold), ',') AS kg FROM r WHERE len(reasons) = 0),
  l AS (SELECT list({{'id': id, 'q': kq, 'g': kg, 'ids': []::BIGINT[], 'sq': []::VARCHAR[], 'sg': []::VARCHAR[]}} ORDER BY id) AS rows FROM k),
  f AS MATERIALIZED (SELECT list_reduce(list_prepend({{'id': -1::BIGINT, 'q': '', 'g': '', 'ids': []::BIGINT[], 'sq': []::VARCHAR[], 'sg': []::VARCHAR[]}}, rows), lambda s, x: CASE WHEN list_contains(s.sq, x.q) OR list_contains(s.sg, x.g) THEN s
    ELSE {{'id': x.id, 'q': '', 'g': '', 'ids': list_append(s.ids, x.id), 'sq': list_append(s.sq, x.q), 'sg': list_append(s.sg, x.g)}} END).ids AS ids FROM l),
  taken AS MATERIALIZED (SELECT k.* FROM k JOIN (SELECT unnest(ids) AS id FROM f) USING (id)),
  first AS (SELECT kq, min(id) AS id FROM taken GROUP BY kq),
  fold AS (SELECT k.id, CASE WHEN t.id IS NOT NULL THEN NULL WHEN p.id < k.id THEN 'duplicate_question' ELSE 'duplicate_gold_set' END AS why FROM k LEFT JOIN taken t ON t.id = k.id LEFT JOIN first p ON p.kq = k.kq),
  done AS (SELECT r.*, CASE WHEN len(r.reasons) > 0 THEN r.reasons WHEN f.why IS NOT NULL THEN [f.why] ELSE []::VARCHAR[] END AS all_reasons FROM r LEFT JOIN fold f USING (id))"""


@query(rf"""WITH {_FINAL_SQL} SELECT id, qtype, array_to_string(all_reasons, ',') AS reasons, len(all_reasons) = 0 AS final FROM done""")
def finalize_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The finalised benchmark."""
    done = gates.finalise(gates.finalise_reasons(*_questions(spark, sf)), "id")
    return done.select("id", "qtype", F.array_join("reasons", ",").alias("reasons"), "final")


_COUNTED = lambda rows, key: rf"""(SELECT '{{{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}}}' FROM (SELECT {key} AS k, count(*) AS n FROM {rows} GROUP BY 1))"""


@query(rf"""WITH {_FINAL_SQL}, fin AS (SELECT *, CASE WHEN vk > 1 THEN 'g' ELSE '?' END AS gm, CASE vk WHEN 0 THEN 'unknown' WHEN 1 THEN '?' ELSE 'j' END AS jm FROM done WHERE len(all_reasons) = 0)
  SELECT {_COUNTED('fin', 'qtype')} AS by_type, {_COUNTED('fin', "CASE WHEN notes LIKE '%review:llm%' THEN 'llm' ELSE 'human' END")} AS review_modes, {_COUNTED('(SELECT unnest(all_reasons) AS r FROM done)', 'r')} AS rejected_by_reason,
    (SELECT '["' || string_agg(DISTINCT gm, '","' ORDER BY gm) || '"]' FROM fin) AS generator_models, (SELECT '["' || string_agg(DISTINCT jm, '","' ORDER BY jm) || '"]' FROM fin) AS judge_models,
    (SELECT count(*) FROM fin WHERE gm = jm) AS self_judged_questions, (SELECT count(*) FROM fin WHERE gm = 'g') AS stability_self_judged_questions, (SELECT count(*) FROM done WHERE len(all_reasons) > 0) AS rejected_total""".replace("{{", "{").replace("}}", "}"))
def benchmark_manifest(spark: SparkSession, sf: str) -> DataFrame:
    row = gates.manifest(gates.finalise(gates.finalise_reasons(*_questions(spark, sf)), "id"), "g")
    return row.select(*[F.to_json(c).alias(c) if "map" in t or "array" in t else F.col(c) for c, t in row.dtypes])


@query(rf"""WITH {_RUNS_SQL}, g AS (SELECT doc_id AS id, 0 AS run, doc_id % 5 <> 0 AS ok FROM labels WHERE doc_id % 7 <> 0), every AS (SELECT * FROM runs UNION ALL SELECT * FROM g),
  w AS (SELECT id, list(ok ORDER BY run) AS verdicts FROM every GROUP BY id HAVING count(DISTINCT run) = 4) SELECT id, array_to_string(list_transform(verdicts, lambda x: x::INT::VARCHAR), '') AS verdicts FROM w""")
def stability_with_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of the judge runs and, as one more run, of the audit noted when a question was made; broken notes give none."""
    i = F.col("doc_id")
    q = V.table(spark, sf, "labels").select(i.alias("id"), F.when(i % 7 == 0, "broken").otherwise(F.to_json(F.struct((i % 5 != 0).alias("ok")))).alias("validation"))
    rows = gates.judged_in_every_run(_judge_runs(spark, sf).unionByName(gates.generation_run(q)))
    return rows.select("id", F.array_join(F.transform("verdicts", lambda v: v.cast("int").cast("string")), "").alias("verdicts"))


@query(rf"""WITH {_Q_SQL}, f AS (SELECT * FROM r WHERE len(reasons) = 0), n AS (SELECT count(*) AS n FROM f), a AS (SELECT p, count(*) AS c FROM (SELECT unnest(list_distinct(papers)) AS p FROM f) GROUP BY p), b AS (SELECT papers[1] AS p, count(*) AS c FROM f GROUP BY 1)
  SELECT n AS n_questions, (SELECT count(*) FROM a) AS n_distinct_papers, round((SELECT max(c) FROM a) / n, 3) AS max_paper_share, round((SELECT max(c) FROM b) / n, 3) AS max_paper_share_first_paper FROM n""")
def max_paper_share(spark: SparkSession, sf: str) -> DataFrame:
    return gates.paper_shares(gates.finalise_reasons(*_questions(spark, sf)).where(F.size("reasons") == 0))


@query(rf"""WITH {_Q_SQL}, c AS (SELECT qtype, count(*) AS n FROM r WHERE len(reasons) = 0 GROUP BY qtype), w AS (SELECT unnest(['simple', 'chain', 'other']) AS qtype, unnest([15, 30000, 1]::BIGINT[]) AS need)
  SELECT qtype, need, coalesce(n, 0) AS n, coalesce(n, 0) >= need AS ok FROM w LEFT JOIN c USING (qtype)""")
def type_minimums(spark: SparkSession, sf: str) -> DataFrame:
    counts = gates.finalise_reasons(*_questions(spark, sf)).where(F.size("reasons") == 0).groupBy("qtype").agg(F.count("*").alias("n"))
    return gates.check_minimums(counts, "simple=15,chain=30000,other=1")


@query(rf"WITH {_Q_SQL} SELECT coalesce(CASE WHEN notes LIKE '%review:llm%' THEN 'llm' ELSE 'human' END, 'none') AS mode, count(*) AS n, min(CASE WHEN notes LIKE '%review:llm%' THEN 'seen review:new' ELSE 'late review:new' END) AS rewritten FROM q GROUP BY 1")
def review_modes(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark, sf)[0].select(T.review_mode(F.col("notes")).alias("mode"), T.with_review_mode(F.col("notes"), F.lit("new")).alias("rewritten"))
    return q.groupBy("mode").agg(F.count("*").alias("n"), F.min("rewritten").alias("rewritten"))


@query(rf"WITH {_Q_SQL} SELECT id FROM q WHERE vk > 1")
def self_judge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return gates.self_judge_conflicts(_questions(spark, sf)[0], "g")


@query(rf"WITH {_Q_SQL} SELECT id, qtype || '-' || substr(sha1(question), 1, 8) AS question_id, trim(regexp_replace(lower(question), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS normal FROM q")
def question_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf)[0].select("id", T.question_id(F.col("qtype"), F.col("question")).alias("question_id"), T.normal_question(F.col("question")).alias("normal"))


# --- run logs: an hour's events are a run ---

_LOG_SQL = r"""e AS (SELECT floor(epoch(ts))::BIGINT // 3600 AS run_no, event_type, event_id, value FROM events),
  o AS (SELECT run_no, CASE event_id % 4 WHEN 0 THEN 'attempt:' || event_type WHEN 1 THEN 'survived:' || event_type WHEN 2 THEN 'passed' ELSE 'pair:' || event_type || ':near_duplicate' END AS key, count(*) AS n FROM e GROUP BY 1, 2),
  t AS (SELECT run_no, sum(event_id % 101) AS pt, sum(event_id % 53) AS ct, count(*) AS calls, count(*) FILTER (WHERE event_id % 3 = 0) AS hits, min(event_id) % 3 AS k FROM e GROUP BY run_no)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    e = V.table(spark, sf, "events").withColumn("run_no", F.floor(F.unix_timestamp("ts") / 3600))
    key = F.when(i % 4 == 0, F.concat(F.lit("attempt:"), "event_type")).when(i % 4 == 1, F.concat(F.lit("survived:"), "event_type")).when(i % 4 == 2, "passed").otherwise(F.concat(F.lit("pair:"), "event_type", F.lit(":near_duplicate")))
    outcomes = e.groupBy("run_no", key.alias("key")).agg(F.count("*").alias("n")).groupBy("run_no").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("outcomes"))
    t = e.groupBy("run_no").agg(F.sum(i % 101).alias("pt"), F.sum(i % 53).alias("ct"), F.count("*").alias("calls"), F.count_if(i % 3 == 0).alias("hits"), (F.min(i) % 3).alias("k"))
    given = F.create_map(F.lit("provider_prompt_tokens"), F.col("pt"), F.lit("provider_completion_tokens"), F.col("ct"), F.lit("provider_calls"), F.col("calls"), F.lit("cache_hits"), F.col("hits"))
    old = F.create_map(F.lit("prompt_tokens"), F.col("pt"), F.lit("completion_tokens"), F.col("ct"), F.lit("provider_calls"), F.col("calls"), F.lit("cache_hits"), F.col("hits"))
    stop = F.when(F.col("k") == 0, "rate_limited").when(F.col("k") == 1, "token_budget")
    return outcomes.join(t, "run_no").select("run_no", "outcomes", F.when(F.col("k") == 2, old).otherwise(given).alias("llm"), stop.alias("stop_reason"), F.concat(F.lit("m"), "k").alias("model"), F.when(F.col("k") != 1, F.concat(F.lit("j"), "k")).alias("judge_model"))


@query(rf"""WITH {_LOG_SQL}, w AS (SELECT run_no, string_split(key, ':')[2] AS qtype, sum(n) FILTER (WHERE starts_with(key, 'attempt:')) AS attempts, coalesce(sum(n) FILTER (WHERE starts_with(key, 'survived:')), 0) AS survived FROM o WHERE starts_with(key, 'attempt:') OR starts_with(key, 'survived:') GROUP BY 1, 2)
  SELECT run_no, qtype, attempts::BIGINT AS attempts, survived::BIGINT AS survived, round_even(survived::DOUBLE / attempts, 3) AS survival_rate FROM w WHERE attempts IS NOT NULL""")
def run_yield(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.run_yield(_runs(spark, sf))


@query(rf"""WITH {_LOG_SQL}, r AS (SELECT run_no, key AS reason, n, row_number() OVER (PARTITION BY run_no ORDER BY n DESC, key) AS rank FROM o WHERE starts_with(key, 'pair:')) SELECT run_no, rank, reason, n FROM r WHERE rank <= 8""")
def run_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.rejections(_runs(spark, sf)).select("run_no", F.col("rank").cast("long").alias("rank"), "reason", "n")


@query(rf"""WITH {_LOG_SQL}, r AS (SELECT count(*) AS runs, coalesce(sum(pt + ct) FILTER (WHERE k <> 2), 0)::BIGINT AS provider_tokens_total, sum(calls)::BIGINT AS provider_calls_total, sum(hits)::BIGINT AS cache_hits_total, 0::BIGINT AS rate_limit_errors_total,
    count(*) FILTER (WHERE k = 0) AS runs_stopped_by_rate_limit, count(*) FILTER (WHERE k = 1) AS runs_stopped_by_token_budget, string_agg(DISTINCT 'm' || k, ',' ORDER BY 'm' || k) AS generator_models, coalesce(string_agg(DISTINCT 'j' || k, ',' ORDER BY 'j' || k) FILTER (WHERE k <> 1), '') AS judge_models FROM t)
  SELECT r.*, (SELECT count(*) FROM events) AS saved_total, (SELECT count(DISTINCT p) FROM (SELECT unnest(CASE WHEN event_id % 5 = 4 THEN ['p1', 'p1'] ELSE ['p' || (event_id % 11), 'p' || (event_id % 7 + 11)] END) AS p FROM events)) AS distinct_gold_papers,
    round_even(provider_tokens_total::DOUBLE / (SELECT count(*) FROM events), 0)::BIGINT AS tokens_per_saved_candidate, (SELECT count(*) FROM events WHERE event_id % 31 = 1) AS saved_without_judge_model,
    (SELECT '{{' || string_agg('"' || q || '":' || n, ',' ORDER BY q) || '}}' FROM (SELECT {_KIND_SQL} AS q, count(*) AS n FROM events GROUP BY 1)) AS saved_per_type FROM r""")
def pilot_summary(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.pilot_summary(_runs(spark, sf), _questions(spark, sf)[0]).withColumn("saved_per_type", F.to_json("saved_per_type"))


@query(rf"""WITH {_LOG_SQL}, w AS (SELECT run_no, string_split(key, ':')[2] AS qtype, coalesce(sum(n) FILTER (WHERE starts_with(key, 'survived:')), 0) AS s FROM o WHERE starts_with(key, 'attempt:') OR starts_with(key, 'survived:') GROUP BY 1, 2 HAVING count(*) FILTER (WHERE starts_with(key, 'attempt:')) > 0),
  v AS (SELECT t.*, coalesce((SELECT sum(s) FROM w WHERE w.run_no = t.run_no), 0)::BIGINT AS surv, CASE WHEN k = 2 THEN 0 ELSE pt + ct END::BIGINT AS tokens FROM t)
  SELECT run_no, surv AS total_survivors, tokens AS provider_tokens, calls AS provider_calls, NULL::DOUBLE AS rate_limit_errors, round_even(tokens::DOUBLE / nullif(surv, 0), 0) AS tokens_per_survivor,
    CASE k WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'token_budget' END AS stop_reason, CASE WHEN k <> 1 THEN 'j' || k END AS judge_model, 'm' || k AS model FROM v""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    row = runlog.run_summary(_runs(spark, sf))
    return row.withColumn("rate_limit_errors", F.col("rate_limit_errors").cast("double")).withColumn("tokens_per_survivor", F.col("tokens_per_survivor").cast("double"))


_BLOB = r"""'[' || CASE WHEN item_id % 2 = 0 THEN '"m"' ELSE '"é"' END || ', [{{"content": ' || said || ', "role": "user"}}], ' || CASE WHEN item_id % 3 = 0 THEN '0.0' ELSE '0.2' END || ', 700, ' || CASE WHEN item_id % 5 = 0 THEN '"low"' ELSE 'null' END || ', null]'"""


@query(rf"""WITH c AS (SELECT item_id, list_transform(regexp_extract_all('say "' || text || '"\' || chr(10) || 'é 😀', '(?s).'), lambda x: CASE WHEN x = '"' THEN '\"' WHEN x = '\' THEN '\\' WHEN x = chr(10) THEN '\n' WHEN x = chr(9) THEN '\t' WHEN x = chr(13) THEN '\r'
      WHEN unicode(x) > 65535 THEN format('\u{{:04x}}', 55296 + (unicode(x) - 65536) // 1024) || format('\u{{:04x}}', 56320 + (unicode(x) - 65536) % 1024) WHEN unicode(x) > 127 THEN format('\u{{:04x}}', unicode(x)) ELSE x END) AS l FROM benchmark),
  q AS (SELECT item_id, '"' || array_to_string(l, '') || '"' AS said FROM c) SELECT item_id, sha256(replace({_BLOB}, 'é', '\u00e9')) AS key FROM q""".replace("{{", "{").replace("}}", "}"))
def request_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Cache keys of requests that quote every benchmark passage."""
    i = F.col("item_id")
    said = F.concat(F.lit('say "'), F.col("text"), F.lit('"\\\né 😀'))
    key = runlog.request_key(F.when(i % 2 == 0, "m").otherwise("é"), F.array(F.struct(F.lit("user").alias("role"), said.alias("content"))), F.when(i % 3 == 0, F.lit(0.0)).otherwise(F.lit(0.2)), F.lit(700), F.when(i % 5 == 0, "low"))
    return V.table(spark, sf, "benchmark").select("item_id", key.alias("key"))


@query(rf"""WITH {_LOG_SQL}, c AS (SELECT run_no, (pt + ct)::BIGINT AS tokens, (sum(pt + ct) OVER (ORDER BY run_no))::BIGINT AS cumulative FROM t) SELECT *, cumulative >= 50000 AS over FROM c""")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.budget(_runs(spark, sf), 50_000)


@query(rf"WITH {_LOG_SQL} SELECT run_no, CASE k WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'token_budget' END AS stop_reason, 'm' || k AS model FROM t ORDER BY run_no DESC LIMIT 1")
def last_run(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.last_run(_runs(spark, sf)).select("run_no", "stop_reason", "model")


@query(rf"""WITH {_Q_SQL}, h AS (SELECT qtype, count(*) FILTER (WHERE status IN ('candidate', 'accepted')) AS have FROM q GROUP BY qtype), t AS (SELECT unnest(['simple', 'chain', 'other']) AS qtype, unnest([100, 30000, 5]::BIGINT[]) AS target)
  SELECT qtype, coalesce(have, 0) AS have, target, greatest(target - coalesce(have, 0), 0) AS missing FROM t LEFT JOIN h USING (qtype)""")
def pending_by_type(spark: SparkSession, sf: str) -> DataFrame:
    targets = spark.createDataFrame([("simple", 100), ("chain", 30000), ("other", 5)], "qtype string, target long")
    return runlog.pending(_questions(spark, sf)[0], targets)


_CALLS_SQL = r"""calls AS (SELECT conv_id AS query, turn, role <> 'assistant' AS hit, length(coalesce(text, '')) AS pt, turn % 5 AS ct FROM conversations)"""


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations").select(F.col("conv_id").alias("query"), F.col("turn").alias("call_no"), (F.col("role") != "assistant").alias("cache_hit"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("prompt_tokens"), (F.col("turn") % 5).alias("completion_tokens"))


@query(rf"WITH {_CALLS_SQL} SELECT query, count(*) AS calls, sum(pt)::BIGINT AS prompt_tokens, sum(ct)::BIGINT AS completion_tokens, count(*) FILTER (WHERE NOT hit) AS provider_calls, coalesce(sum(pt + ct) FILTER (WHERE NOT hit), 0)::BIGINT AS provider_tokens FROM calls GROUP BY query")
def cache_hit_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.call_accounting(_calls(spark, sf))


@query(rf"WITH {_CALLS_SQL} SELECT query AS stream, turn AS seq, 1::BIGINT AS calls, (pt + ct)::BIGINT AS tokens FROM calls")
def counter_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of running counters give back what each call added."""
    from pyspark.sql import Window as W

    line = W.partitionBy("query").orderBy("call_no").rowsBetween(W.unboundedPreceding, 0)
    running = _calls(spark, sf).select(F.col("query").alias("stream"), F.col("call_no").alias("seq"), F.count("*").over(line).alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).over(line).alias("tokens"))
    return runlog.counter_deltas(running)


@query(r"""WITH cache AS (SELECT sha256(event_id::VARCHAR) AS key, CASE WHEN event_id % 2 = 1 THEN 'reply ' || event_id ELSE '  ' END AS text FROM events WHERE event_id % 3 = 1),
  good AS (SELECT key, text FROM cache WHERE trim(text) <> '') SELECT event_id, g.key IS NOT NULL AS cache_hit, g.text AS cached FROM events e LEFT JOIN good g ON g.key = sha256(e.event_id::VARCHAR)""")
def cache_read_through(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the requests is cached, every other of them by a corrupt entry."""
    i = F.col("event_id")
    e = V.table(spark, sf, "events")
    requests = e.select("event_id", F.sha2(i.cast("string"), 256).alias("key"))
    cache = e.where(i % 3 == 1).select(F.sha2(i.cast("string"), 256).alias("key"), F.when(i % 2 == 1, F.concat(F.lit("reply "), i)).otherwise("  ").alias("text"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"))
    return runlog.read_through(requests, cache).select("event_id", "cache_hit", "cached")


_HINTS = ("Please try again in 2.505s.", "try again in 1m30.5s", "Try Again in 350ms", "try again in 1h2m3s", "no hint")


@query(rf"""WITH m AS (SELECT event_id, event_id % 4 AS n, regexp_extract({sql_list(_HINTS)}[event_id % 5 + 1], '(?i)try again in\s+((?:\d+(?:\.\d+)?(?:ms|h|m|s)\s*)+)', 1) AS hint FROM events),
  p AS (SELECT event_id, n, hint, regexp_extract_all(hint, '(\d+(?:\.\d+)?)(ms|h|m|s)', 1) AS a, regexp_extract_all(hint, '(\d+(?:\.\d+)?)(ms|h|m|s)', 2) AS u FROM m),
  h AS (SELECT event_id, n, CASE WHEN hint <> '' THEN list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::DOUBLE * CASE u[i] WHEN 'ms' THEN 0.001 WHEN 's' THEN 1 WHEN 'm' THEN 60 ELSE 3600 END)) END AS w FROM p)
  SELECT event_id, round(w, 6) AS wait, round(CASE WHEN w > 30 THEN NULL WHEN w IS NOT NULL THEN w + 0.5 ELSE least(pow(2, n), 8) END, 6) AS retry, round(CASE WHEN w > 30 THEN NULL ELSE coalesce(w, 10) + 0.5 END, 6) AS batch, round(coalesce(ceil(w) + 2, least(30 * pow(2, n), 900)), 6) AS cooldown FROM h""")
def wait_hint_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("event_id", (F.col("event_id") % 4).alias("n"), T.wait_seconds(_pick(_HINTS, F.col("event_id") % 5)).alias("w"))
    return e.select("event_id", R6("w").alias("wait"), R6(runlog.retry_delay(F.col("n"), F.col("w"))).alias("retry"), R6(runlog.batch_wait(F.col("w"))).alias("batch"), R6(runlog.cooldown(F.col("n"), F.col("w"))).alias("cooldown"))


# --- integrity ---


@query(r"""WITH c AS (SELECT source AS paper_id, doc_id, sha256(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) AS h, length(coalesce(text, '')) AS n FROM documents)
  SELECT paper_id, count(*) AS n_chunks, sum(n)::BIGINT AS chars, sha256(string_agg(h, chr(10) ORDER BY doc_id)) AS text_sha256 FROM c GROUP BY paper_id""")
def corpus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    chunks = V.chunks(spark, sf)
    return integrity.corpus_manifest(chunks.select("paper_id"), chunks)


@query(r"""WITH d AS (SELECT doc_id AS p, sha256(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) AS h FROM documents), told AS (SELECT p, CASE WHEN p % 10 = 2 THEN 'other' ELSE h END AS h FROM d WHERE p % 10 <> 1), found AS (SELECT * FROM d WHERE p % 10 <> 0),
  j AS (SELECT CASE WHEN f.p IS NULL THEN 'missing_paper' WHEN t.p IS NULL THEN 'unlisted_paper' WHEN t.h <> f.h THEN 'text_drift' END AS problem FROM told t FULL JOIN found f ON t.p = f.p) SELECT 'error' AS level, problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY problem""")
def manifest_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest that lists documents that went, lacks new ones, and told others differently."""
    d = V.chunks(spark, sf).select(F.col("chunk_idx").alias("paper_id"), T.sha256_lf(F.col("text")).alias("text_sha256"))
    told = d.where("paper_id % 10 <> 1").withColumn("text_sha256", F.when(F.col("paper_id") % 10 == 2, "other").otherwise(F.col("text_sha256")))
    return integrity.manifest_drift(told, d.where("paper_id % 10 <> 0"))


@query(r"""SELECT 'error' AS level, problem, n FROM (VALUES ('missing_label', (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL)), ('unknown_label', (SELECT count(*) FROM labels WHERE doc_id % 6 = 5))) t(problem, n) WHERE n > 0""")
def sidecar_check(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("SIMPLE", "MULTI_HOP", "UNCERTAIN", "SIMPLE", "MULTI_HOP", "OTHER")
    labels = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), _pick(kinds, F.col("doc_id") % 6).alias("label"))
    return integrity.sidecar_problems(labels, V.table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@query(r"""WITH told AS (SELECT page_id AS p, sha256(html) AS h FROM pages), found AS (SELECT p, CASE WHEN p % 5 = 1 THEN 'x' ELSE h END AS h FROM told WHERE p % 5 <> 0),
  j AS (SELECT CASE WHEN f.p IS NULL THEN 'missing_binary' WHEN t.h <> f.h THEN 'different_binary' END AS problem FROM told t LEFT JOIN found f ON t.p = f.p) SELECT 'warning' AS level, problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY problem""")
def binary_drift(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "pages").select(F.col("page_id").alias("paper_id"), F.sha2(F.col("html").cast("binary"), 256).alias("binary_sha256"))
    found = p.where("paper_id % 5 <> 0").withColumn("binary_sha256", F.when(F.col("paper_id") % 5 == 1, "x").otherwise(F.col("binary_sha256")))
    return integrity.binary_drift(p, found)


@query(r"""WITH d AS (SELECT doc_id::VARCHAR AS path, doc_id % 4 AS k, substr(sha256(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))), 1, 16) AS h FROM documents), b AS (SELECT * FROM d WHERE k <> 1), a AS (SELECT path, CASE WHEN k = 2 THEN 'x' ELSE h END AS h FROM d WHERE k <> 0),
  j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' WHEN a.h <> b.h THEN 'changed' END AS change FROM b FULL JOIN a ON a.path = b.path) SELECT path, change FROM j WHERE change IS NOT NULL""")
def frozen_drift(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("chunk_idx")
    d = V.chunks(spark, sf).select(i, i.cast("string").alias("path"), F.substring(T.sha256_lf(F.col("text")), 1, 16).alias("digest"))
    now = d.where("chunk_idx % 4 <> 0").withColumn("digest", F.when(i % 4 == 2, "x").otherwise(F.col("digest")))
    return integrity.frozen_drift(d.where("chunk_idx % 4 <> 1").select("path", "digest"), now.select("path", "digest"))
