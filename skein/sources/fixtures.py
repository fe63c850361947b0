"""Input tables derived from the driver's tables (recipes in FIXTURES.md).

The reference ships no data; these recipes turn ``conversations``,
``embeddings``, ``documents`` and ``labels`` into completions, designs,
pairs and prompts.  The modulo expressions below pick a *variant* or partner per
row, they filter nothing out; completions come from assistant turns, partners by
number need ids 0 to n - 1, which is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import RESIDUES
from skein.sources.tables import read_table

# ---- fixed values (fixture recipe) ----------------------------------------
HEX_DIGITS = "0123456789abcdef"
HEX_TO_RESIDUE = "ACDEFGHIKLMNPQRS"
PAIR_SYSTEM_PROMPT = ("You compare two peptides. Put your reasons inside <think> </think>, then "
                      "yes or no inside <answer> </answer>.")
DOC_SYSTEM_PROMPT = "Read the passage and answer yes or no."
# ---------------------------------------------------------------------------

col = F.col


def _fmt3(thousandths: Column) -> Column:
    """k/1000 rendered with three decimals from the integer (no float text)."""
    return F.when(thousandths == 1000, F.lit("1.000")).otherwise(
        F.concat(F.lit("0."), F.lpad(thousandths.cast("string"), 3, "0")))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer-mode completions: one per assistant turn of ``conversations``.

    Variant ``v`` picks the tag layout (well-formed, adjacent tags, mixed-case
    tag, no tags, nested, four thinks, reversed, too long, unclosed).
    """
    return completions_from(read_table(spark, sf_dir, "conversations"))


def completions_from(conversations: DataFrame) -> DataFrame:
    """The completions recipe over any ``conversations`` frame (batch or stream)."""
    conv = (conversations.filter(col("role") == "assistant")
            .select("conv_id", "turn", "text"))
    t = col("text")
    a = (col("conv_id") + col("turn")) % 4
    ans = (F.when(a == 0, "yes").when(a == 1, "no").when(a == 2, "Yes, likely")
           .otherwise("unknown"))
    v = (col("conv_id") * 3 + col("turn")) % 10
    c = F.concat
    L = F.lit
    completion = (
        F.when(v == 2, c(L("<think>"), t, L("</think><answer>"), ans, L("</answer>")))
        .when(v == 3, c(L("<Think>"), t, L("</think> <answer>"), ans, L("</answer>")))
        .when(v == 4, c(t, L(" "), ans))
        .when(v == 5, c(L("<think>"), t, L(" <answer>"), ans, L("</answer></think>")))
        .when(v == 6, c(L("<think>a</think> <think>b</think> <think>c</think> <think>"), t,
                        L("</think> <answer>"), ans, L("</answer>")))
        .when(v == 7, c(L("<answer>"), ans, L("</answer> <think>"), t, L("</think>")))
        .when(v == 8, c(L("<think>"), F.repeat(c(t, L(" ")), 3), L("</think> <answer>"), ans,
                        L("</answer>")))
        .when(v == 9, c(L("<think>"), t, L("</think> <answer>"), ans))
        .otherwise(c(L("<think>"), t, L("</think> <answer>"), ans, L("</answer>"))))
    keywords = (
        F.when(col("conv_id") % 7 == 0, L(""))
        .when(col("conv_id") % 2 == 0,
              c(F.split_part(t, L(" "), L(1)), L("|"), F.split_part(t, L(" "), L(3))))
        .otherwise(c(L("zzz|"), F.split_part(t, L(" "), L(2)))))
    k = (col("conv_id") * 37 + col("turn") * 11) % 1001
    classes = (F.when(col("conv_id") % 5 == 0, L(" YES | no"))
               .when(col("conv_id") % 9 == 0, L("maybe|no|yes"))
               .otherwise(L("no|yes")))
    return conv.select(
        "conv_id", "turn", v.alias("v"), completion.alias("completion"),
        keywords.alias("keywords"), classes.alias("classes"),
        c(_fmt3(1000 - k), L("|"), _fmt3(k)).alias("class_confidences"),
        (k > 500).cast("int").alias("label"),
        F.floor(col("conv_id") / 2).alias("step"), col("turn").alias("pos"))


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designed peptides: lengths 4–17 (both sides of the 5..15 gate),
    low-complexity repeats and invalid lower-case sequences; pLDDT from label."""
    return designs_from(read_table(spark, sf_dir, "embeddings"))


def designs_from(embeddings: DataFrame) -> DataFrame:
    """The designs recipe over any ``embeddings`` frame (batch or stream)."""
    e = embeddings.select("vec_id", "label")
    n = 4 + col("vec_id") % 14
    s = F.translate(F.substring(F.md5(col("vec_id").cast("string")), F.lit(1), n.cast("int")),
                    HEX_DIGITS, HEX_TO_RESIDUE)
    seq = (F.when(col("vec_id") % 11 == 0, F.lower(s))
           .when(col("vec_id") % 5 == 0, F.repeat(F.substring(s, 1, 2), 6))
           .otherwise(s))
    return e.select(col("vec_id").alias("id"), seq.alias("seq"),
                    (50 + 5 * col("label")).cast("double").alias("plddt"), "label")


def seq_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding table keyed by design sequence (unique on ``seq``).

    Only sequences of residue letters are embeddable, so the invalid designs
    have no vector — pairs touching them exercise the missing-key rules.
    A sequence designed twice keeps the vector of its lowest id.
    """
    d = designs(spark, sf_dir).filter(col("seq").rlike(rf"\A[{RESIDUES}]+\z"))
    e = read_table(spark, sf_dir, "embeddings").select(
        col("vec_id").alias("id"), "embedding")
    return (d.join(e, "id")
            .groupBy("seq").agg(F.min_by("embedding", "id").alias("embedding")))


def _numbered(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``embeddings``; their ids must be 0 to n - 1, as partners are found by
    number."""
    r = read_table(spark, sf_dir, "embeddings").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids"),
        F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).head()
    if r.n and (r.ids, r.low, r.high) != (r.n, 0, r.n - 1):
        raise ValueError(f"vec_id isn't 0 to n - 1: {r}")
    return r.n


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs: design ``id`` against design ``(7 id + 3) mod n``."""
    d = designs(spark, sf_dir)
    n = _numbered(spark, sf_dir)
    a = d.select(col("id").alias("pair_id"), col("seq").alias("seqA"),
                 col("plddt").alias("seqA_plddt"),
                 ((col("id") * 7 + 3) % n).alias("partner"))
    b = d.select(col("id").alias("partner"), col("seq").alias("seqB"),
                 col("plddt").alias("seqB_plddt"))
    return a.join(b, "partner").drop("partner")


def pair_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts scored by the pair model (keywords ``seqA|seqB``).

    Every 17th pair carries a single keyword (no score → 0.5); the annotated
    label uses ``>=`` so ties disagree with the derived ``>`` label.
    """
    p = pairs(spark, sf_dir)
    kw = F.when(col("pair_id") % 17 == 0, col("seqA")).otherwise(
        F.concat(col("seqA"), F.lit("|"), col("seqB")))
    return p.select(
        "pair_id",
        F.lit(PAIR_SYSTEM_PROMPT).alias("system_prompt"),
        F.concat(F.lit("Is "), col("seqA"), F.lit(" more likely to bind than "), col("seqB"),
                 F.lit("? Answer yes or no.")).alias("user_prompt"),
        kw.alias("keywords"), F.lit("pair_preference").alias("task"),
        (col("seqA_plddt") >= col("seqB_plddt")).cast("int").alias("label"),
        "seqA_plddt", "seqB_plddt")


def doc_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with a given probability (``prob_score``) and label.

    Label comes from ``labels.quality`` (left join: unlabelled documents keep
    a null label); toxic documents are labelled 2, outside {0, 1}.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source",
                                                        "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(lab, "doc_id", "left")
    label = F.when(col("toxic") == 1, F.lit(2)).otherwise(col("quality"))
    return j.select(
        "doc_id",
        F.lit(DOC_SYSTEM_PROMPT).alias("system_prompt"),
        F.concat(F.lit("Is this passage of good quality? "),
                 col("text")).alias("user_prompt"),
        F.concat(col("lang"), F.lit("|"), col("source")).alias("keywords"),
        col("source").alias("task"), label.cast("int").alias("label"),
        ((col("n_chars") % 1001) / 1000.0).alias("prob_score"))


def design_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design prompts: candidate (reference) sequence and its pLDDT."""
    d = designs(spark, sf_dir)
    return d.select(
        col("id").alias("prompt_id"),
        F.lit(PAIR_SYSTEM_PROMPT).alias("system_prompt"),
        F.concat(F.lit("Design a cyclic peptide that binds better than "), col("seq"),
                 F.lit(".")).alias("user_prompt"),
        F.concat(col("seq"), F.lit("|"), F.substring(col("seq"), 1, 3)).alias("keywords"),
        F.lit("design").alias("task"),
        col("seq").alias("candidate"), col("plddt").alias("candidate_plddt"))


def design_completions(spark: SparkSession, sf_dir: str,
                       generated: DataFrame | None = None) -> DataFrame:
    """Design-mode completions: design ``id`` answers against reference
    design ``(3 id + 1) mod n``.  Variants: well-formed, adjacent tags with
    padded answer, no answer block, empty answer block.

    ``generated`` (an ``embeddings`` frame, e.g. a stream) supplies the
    generating side; the reference side is the static table.
    """
    d = designs(spark, sf_dir)
    n = _numbered(spark, sf_dir)
    g = d if generated is None else designs_from(generated)
    gen = g.select("id", col("seq").alias("gen"),
                   ((col("id") * 3 + 1) % n).alias("ref_id"))
    ref = d.select(col("id").alias("ref_id"), col("seq").alias("candidate"),
                   col("plddt").alias("candidate_plddt"))
    j = gen.join(ref, "ref_id")
    v = col("id") % 6
    c, L = F.concat, F.lit
    completion = (
        F.when(v == 3, c(L("<think>Short.</think><answer> "), col("gen"), L(" </answer>")))
        .when(v == 4, c(L("<think>Reasoning about "), col("candidate"), L("</think> "),
                        col("gen")))
        .when(v == 5, c(L("<think>Trying an empty design for "), col("candidate"),
                        L(".</think> <answer></answer>")))
        .otherwise(c(L("<think>Design close to "), col("candidate"), L(" keeping "),
                     F.substring(col("gen"), 1, 3), L(" motif.</think> <answer>"),
                     col("gen"), L("</answer>"))))
    return j.select(
        "id", completion.alias("completion"),
        c(col("candidate"), L("|"), F.substring(col("gen"), 1, 3)).alias("keywords"),
        "candidate", "candidate_plddt",
        F.floor(col("id") / 8).alias("step"), (col("id") % 8).alias("pos"))


def design_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three design cycles; every 10th design is repeated in the next cycle."""
    d = designs(spark, sf_dir)
    c = col("id") % 3
    cycles = F.when(col("id") % 10 == 0, F.array(c, (c + 1) % 3)).otherwise(F.array(c))
    return d.select(F.explode(cycles).alias("cycle"), col("seq").alias("generate_seq"),
                    "plddt")


def judge_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled judge responses: one per completion, design = conversation."""
    from skein.functions.text import first_keyword
    comp = completions(spark, sf_dir)
    return comp.select(col("conv_id").cast("string").alias("design_seq"),
                       first_keyword("keywords").alias("ref_seq"),
                       col("completion").alias("answers"))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue vectors: sequence = ``label``, position = order of ``vec_id``."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(col("label").alias("seq_key"), col("vec_id").alias("position"),
                    "embedding")
