import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.vectors import cosine


def one(spark, column, *values):
    names = [chr(97 + i) for i in range(len(values))]
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)]).select(column.alias("x")).first().x


def test_tokens_are_words_of_any_script(spark):
    assert one(spark, T.tokens(F.col("a")), "Éa H₀ σ8 73.04 a_b") == ["éa", "h₀", "σ8", "73", "04", "a_b"]
    assert one(spark, T.tokens(F.col("a")), "") == []


def test_noise_fraction(spark):
    assert one(spark, T.noise_fraction(F.col("a")), "0.0 0.5 1.0 z 60 90") == pytest.approx(5 / 6)
    assert one(spark, T.noise_fraction(F.col("a")), "") == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_md5_bucket_is_the_128_bit_modulus(spark, keys):
    keys = [k.replace("\x00", "") .encode("utf-8", "ignore").decode() for k in keys]
    got = [r.x for r in spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").orderBy("i").select(T.md5_bucket(F.col("k"), 1000).alias("x")).collect()]
    assert got == [int(hashlib.md5(k.encode()).hexdigest(), 16) % 1000 for k in keys]


def test_paper_split(spark):
    assert one(spark, T.md5_bucket(F.col("a"), 1000), "p1") == 52
    share = spark.range(2000).select(T.paper_split(F.concat(F.lit("p"), "id")).alias("s")).where("s = 'test'").count() / 2000
    assert 0.25 < share < 0.35


@pytest.mark.parametrize("message, seconds", [("try again in 2.505s", 2.505), ("Try again in 1m30.5s.", 90.5), ("try again in 350ms", 0.35), ("try again in 1h2m3s", 3723.0), ("later", None)])
def test_wait_seconds(spark, message, seconds):
    got = one(spark, T.wait_seconds(F.col("a")), message)
    assert got is None if seconds is None else got == pytest.approx(seconds)


def test_question_forms(spark):
    assert one(spark, T.normal_question(F.col("a")), "  What, is H0?! ") == "what is h0"
    assert one(spark, T.collapsed(F.col("a")), " What\n is  IT ") == "what is it"
    assert one(spark, T.question_id(F.lit("simple"), F.col("a")), "q") == "simple-" + hashlib.sha1(b"q").hexdigest()[:8]
    assert one(spark, T.sha256_lf(F.col("a")), "a\r\nb") == hashlib.sha256(b"a\nb").hexdigest()


def test_json_in_text(spark):
    assert one(spark, T.greedy_object(F.col("a")), 'x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert one(spark, T.greedy_object(F.col("a")), "none") is None
    assert one(spark, T.greedy_array(F.col("a")), 'x ["a", "b"] y') == '["a", "b"]'
    assert one(spark, T.without_comments(F.col("a")), '{"a": true, // yes\n"b": 1}') == '{"a": true, \n"b": 1}'


def test_review_tags(spark):
    assert one(spark, T.review_mode(F.col("a")), "x review:human review:llm") == "human"
    assert one(spark, T.review_mode(F.col("a")), "nothing") is None
    assert one(spark, T.with_review_mode(F.col("a"), F.lit("llm")), "x review:human y") == "x y review:llm"


def test_quota_phrases(spark):
    assert one(spark, T.quota_exhausted(F.col("a")), "Limit: tokens per day") is True
    assert one(spark, T.quota_exhausted(F.col("a")), "busy") is False


def test_cosine_of_no_length_is_zero(spark):
    assert spark.sql("select array(1.0, 0.0) a, array(0.0, 0.0) b").select(cosine(F.col("a"), F.col("b")).alias("x")).first().x == 0.0
