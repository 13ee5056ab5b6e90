"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, class_lm, exact_dedup, mixing, near_dedup, packing, quality, substring_dedup, toxicity
from .common import Scratch, read_table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mixing.mix_sources(docs, keep=["doc_id"], weights=(3, 1, 2), share=1.5, max_copies=2)
    return mixed.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    made = chat.format_trees(chat.reply_tree(rows.unionByName(extra)))
    made = Scratch(spark, "op2").save(made, "formatted")
    back = chat.read_back(F.col("formatted"), F.col("loss_mask"))
    read = made.select("tree", F.length("formatted").cast("long").alias("formatted_chars"), back["turns"].alias("turns"), back["loss_text"].alias("loss_text"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), "formatted_chars",
    )


def op3_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(read_table(spark, sf_dir, "embeddings"), every=20, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = toxicity.severity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return graded.withColumnRenamed("id", "doc_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)
    return cleaned.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_components(read_table(spark, sf_dir, "documents"), words=3, percent=85)
    kept = F.col("id").eqNullSafe(F.col("component"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op9_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scores.withColumnRenamed("id", "doc_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(read_table(spark, sf_dir, "documents"), vocabulary_path())
    return placed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), F.col("place").alias("offset")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


SQL = {
    "op1_source_mix": r"""
        WITH d AS (
          SELECT doc_id, source, length(regexp_replace(regexp_replace(' ' || coalesce(text, ''), '[\x20\x09-\x0D]+[^\x20\x09-\x0D]+', chr(1), 'g'), '[^\x01]', '', 'g')) AS size
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM s),
        w AS (SELECT *, CAST([3.0, 1.0, 2.0][i % 3 + 1] AS DOUBLE) AS w, CAST(source_size * 2 AS DOUBLE) AS cap FROM r),
        f AS (
          SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total,
            coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
            sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
          FROM w),
        l AS (SELECT *, (total - cap_before) / w_left AS level FROM f),
        v AS (SELECT (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, i LIMIT 1) AS water),
        t AS (
          SELECT source, source_size, coalesce(least(cap, water * w), cap) AS target,
            ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 7))::BIGINT AS u
          FROM l, v),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS n FROM d),
        e AS (
          SELECT p.doc_id, p.size, t.source_size, t.target, p.n, t.u,
            CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * 268435456.0) AS BIGINT) ELSE 0 END AS step
          FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
          CAST((((n * step + u) >> 28) - (((n - 1) * step + u) >> 28)) * size AS BIGINT) AS taken
        FROM e""",
    "op2_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
          SELECT *,
            length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
            + length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
            + length('<s>[INST]  [/INST]</s>') AS chars
          FROM c),
        g AS (
          SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
          FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
        FROM g""",
    "op5_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        blocks AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 512)) AS start FROM d),
        b AS (SELECT doc_id, start, substr(h, 2 * start + 1, 2 * (512 + 49)) AS piece FROM blocks),
        p AS (SELECT doc_id, start, piece, unnest(range(0, least(512, length(piece) // 2 - 49))) AS j FROM b),
        k AS (SELECT doc_id, start + j AS pos, substr(piece, 2 * j + 1, 100) AS window50 FROM p),
        f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY window50) < doc_id AS repeated FROM k),
        o AS (
          SELECT doc_id, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 1 ELSE 0 END AS fresh
          FROM f WHERE repeated),
        i AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM o),
        r AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 50 AS b FROM i GROUP BY doc_id, span),
        gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
        kept AS (
          SELECT d.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
            string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last
          FROM gap JOIN d USING (doc_id) GROUP BY d.doc_id)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
          sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
          FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (
          SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT doc_id, b FROM reach JOIN link ON other = a),
        g AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
        g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g USING (h)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
