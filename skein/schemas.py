"""Explicit schemas of the toolkit's tables (no inference anywhere)."""

from pyspark.sql.types import (ArrayType, DoubleType, FloatType, IntegerType, LongType,
                               StringType, StructField, StructType)

PROMPT_SCHEMA = StructType([
    StructField("system_prompt", StringType()),
    StructField("user_prompt", StringType()),
    StructField("keywords", StringType()),
    StructField("task", StringType()),
    StructField("label", IntegerType()),
    StructField("seqA_plddt", DoubleType()),
    StructField("seqB_plddt", DoubleType()),
    StructField("prob_score", DoubleType()),
    StructField("candidate", StringType()),
    StructField("candidate_plddt", DoubleType()),
])

CYCLE_SCHEMA = StructType([
    StructField("generate_seq", StringType()),
    StructField("plddt", DoubleType()),
])

PAIR_SCHEMA = StructType([
    StructField("seqA", StringType()),
    StructField("seqA_plddt", DoubleType()),
    StructField("seqB", StringType()),
    StructField("seqB_plddt", DoubleType()),
])

EMBEDDING_SCHEMA = StructType([
    StructField("seq", StringType(), False),
    StructField("embedding", ArrayType(FloatType())),
])

ANSWER_COMPLETION_SCHEMA = StructType([
    StructField("completion", StringType()),
    StructField("classes", StringType()),
    StructField("class_confidences", StringType()),
    StructField("keywords", StringType()),
    StructField("label", IntegerType()),
    StructField("step", LongType()),
    StructField("pos", LongType()),
])

DESIGN_COMPLETION_SCHEMA = StructType([
    StructField("completion", StringType()),
    StructField("keywords", StringType()),
    StructField("candidate", StringType()),
    StructField("candidate_plddt", DoubleType()),
    StructField("step", LongType()),
    StructField("pos", LongType()),
])

JUDGE_SCHEMA = StructType([
    StructField("design_seq", StringType()),
    StructField("ref_seq", StringType()),
    StructField("answers", StringType()),
])
