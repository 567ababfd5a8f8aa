"""Queries of the training-data operators, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import table


def op1_stream_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_shape_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op3_seed_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.chat import chat_digest

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_digest(rows.unionByName(planted))


def op5_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.neardup import near_groups

    return near_groups(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_patricia_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.shards import shard_digest

    return shard_digest(table(spark, sf_dir, "documents"))


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.lm import corpus_scores

    return corpus_scores(table(spark, sf_dir, "documents"))


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.toxicity import toxicity_predictions

    return toxicity_predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_family_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.language import language_predictions

    return language_predictions(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_stream_pieces": op1_stream_pieces,
    "op2_shape_crf": op2_shape_crf,
    "op3_seed_align": op3_seed_align,
    "op4_chat_format": op4_chat_format,
    "op5_minmax_neardup": op5_minmax_neardup,
    "op6_patricia_dedup": op6_patricia_dedup,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_attention_lm": op8_attention_lm,
    "op9_nnpu_toxicity": op9_nnpu_toxicity,
    "op10_family_language": op10_family_language,
}

_ESCAPED = r"regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|SEP\]|/?ROLE\]|TEXT\])', '\1\\\2\3', 'g')"

ORACLES: dict[str, str] = {
    "op4_chat_format": rf"""
        with rows_in as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked as (
          select *, lag(role) over w as before, lead(role) over w as after, row_number() over w as pos from rows_in
          window w as (partition by conv_id order by turn nulls first, role, text)),
        pieces as (
          select *, case when before = role then '[SEP]' when role = 'user' then '[INST]' when role = 'assistant' then ''
              else '[ROLE]' || regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|SEP\]|/?ROLE\]|TEXT\])', '\1\\\2\3', 'g') || '[TEXT]' end
            || {_ESCAPED} || case when after = role then '' when role = 'user' then '[/INST]'
              when role = 'assistant' then '</s>' else '[/ROLE]' end as piece from marked)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
          coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
          sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
          sum(length(piece))::bigint as formatted_chars
        from pieces group by conv_id""",
    "op6_patricia_dedup": """
        with d as (
          select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
          from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from d join g using (text_sha256)""",
}
