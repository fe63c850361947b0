"""Soft-labelled training prompts.

Labels and confidences are columns; the chat messages are an
``array<struct<role,content>>`` and the prompt text is rendered from them
with a caller-supplied template.  The three-decimal confidence text is a column
expression (``numeric.fixed3``) that rounds the exact binary value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.numeric import fixed3

# ---- fixed values ---------------------------------------------------------
CLASSES = "no|yes"
REASONING_SUFFIX = ("\n You will provide the reasoning step-by-step, using detailed "
                    "biological knowledge from the training.")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ChatTemplate:
    """Prompt text = Σ(turn_open + role + role_close + content + turn_close)
    + generation marker.  Model-specific templates are supplied by the caller."""
    turn_open: str = "<|"
    role_close: str = "|>\n"
    turn_close: str = "\n"
    generation: str = "<|assistant|>\n"

    def render(self, messages: Column) -> Column:
        body = F.aggregate(
            messages, F.lit(""),
            lambda acc, m: F.concat(acc, F.lit(self.turn_open), m["role"],
                                    F.lit(self.role_close), m["content"],
                                    F.lit(self.turn_close)))
        return F.concat(body, F.lit(self.generation))


def chat_messages(system="system_prompt", user="user_prompt") -> Column:
    """System + user messages."""
    s = F.col(system) if isinstance(system, str) else system
    u = F.col(user) if isinstance(user, str) else user
    return F.array(F.struct(F.lit("system").alias("role"), s.alias("content")),
                   F.struct(F.lit("user").alias("role"), u.alias("content")))


def confidence_text(first: Column, second: Column) -> Column:
    """``"%.3f|%.3f"`` exactly as Python renders it; null when either is null."""
    return F.concat(fixed3(first), F.lit("|"), fixed3(second))


def soft_label_from_probability(df: DataFrame, prob: str = "probability",
                                template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """label = p > 0.5; confidences ``1-p|p``; classes ``no|yes``."""
    p = F.col(prob)
    return df.select(
        "*",
        template.render(chat_messages()).alias("prompt"),
        (p > 0.5).cast("int").alias("soft_label"),
        F.lit(CLASSES).alias("classes"),
        confidence_text(1.0 - p, p).alias("class_confidences"))


def soft_label_given(df: DataFrame, prob: str = "prob_score", label: str = "label",
                     template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Given probability and label: 1 → ``1-p|p``, 0 → ``p|1-p``,
    any other label → null confidences (Q6)."""
    p, lab = F.col(prob), F.col(label)
    first = F.when(lab == 1, 1.0 - p).when(lab == 0, p)
    second = F.when(lab == 1, p).when(lab == 0, 1.0 - p)
    return df.select(
        "*",
        template.render(chat_messages()).alias("prompt"),
        F.lit(CLASSES).alias("classes"),
        confidence_text(first, second).alias("class_confidences"))


def cycle_prompts(df: DataFrame, balance: bool = True) -> DataFrame:
    """The table, then the table again when ``balance`` (2n rows).

    Replication is a per-row ``explode`` — no join, no global index; the
    emission order is (replica, source order).
    """
    reps = F.array(F.lit(0), F.lit(1)) if balance else F.array(F.lit(0))
    return df.select(F.explode(reps).alias("replica"), "*")


def read_in_order(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files as one table with ``row``, a row's place from 0: files by path,
    rows as they stand in them.

    One job counts the rows of each file (the driver holds one number a file, as
    it does when it lists them); a row's place is its file's offset and its index
    in the file.  Nothing is sorted or shuffled, and a file may be read by many
    tasks.
    """
    rows = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("_file"),
                                             F.col("_metadata.row_index").alias("_at"))
    counts = sorted(rows.groupBy("_file").count().collect())
    offsets, run = [], 0
    for file, n in counts:
        offsets.append((file, run))
        run += n
    table = spark.createDataFrame(offsets, "_file string, _offset long")
    return rows.join(table, "_file").withColumn("row", F.col("_offset") + F.col("_at")).drop("_file", "_offset", "_at")


def ordered_cycle(rows: DataFrame, balance: bool = True) -> DataFrame:
    """P8 in order: ``cycle_prompts`` of a table with ``row``, and ``position``, the
    place of each of the 2n rows: the table, then the table again."""
    n = rows.count()
    return cycle_prompts(rows, balance).withColumn("position", F.col("replica") * F.lit(n) + F.col("row"))


def scoring_copy(df: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``prompt``, rendered from the plain system prompt, and
    ``scoring_prompt``, the same with the reasoning suffix."""
    return df.withColumns({"prompt": template.render(chat_messages()),
                           "scoring_prompt": template.render(chat_messages(system=with_reasoning_suffix()))})


def with_reasoning_suffix(system="system_prompt", suffix: str = REASONING_SUFFIX):
    """The system prompt with the step-by-step suffix (scoring copy only;
    the emitted prompt keeps the plain system prompt)."""
    s = F.col(system) if isinstance(system, str) else system
    return F.concat(s, F.lit(suffix))


DESIGN_EXAMPLE_COLUMNS = ("prompt", "keywords", "task", "system_prompt", "user_prompt",
                          "candidate_plddt", "candidate")


def design_examples(df: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Design-mode training examples (prompt text + prompt columns)."""
    return df.select(
        *[c for c in df.columns if c not in DESIGN_EXAMPLE_COLUMNS],
        template.render(chat_messages()).alias("prompt"),
        *[c for c in DESIGN_EXAMPLE_COLUMNS if c != "prompt"])


def write_examples(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Emit the training examples (parquet or JSON lines)."""
    writer = df.write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'json'")
