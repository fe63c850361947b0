"""Design-mode scoring.

Per completion: the designed sequence, the length gate, diversity from
motif repetition, the design score from the pair scorer on
``vector(design) - vector(reference)``, the ledger penalty, and the total.
Vectors come from J03 over the *distinct* designs and references, joined
back by key — the embedder runs once per sequence, not per completion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import numeric as N
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import embed as E
from skein.operators.formatting import format_checks
from skein.operators.ledger import prior_counts
from skein.operators.scoring import PairScorer
from skein.operators.vectors import attach_pair_vectors

MIN_LEN, MAX_LEN = 5, 15      # length gate for designs
MOTIF_WIDTHS = (2, 3, 4)      # sliding motif widths


def designed_sequences(df: DataFrame, keep: Sequence[str] = (),
                       text_col: str = "completion") -> DataFrame:
    ds = T.designed_sequence(F.col(text_col))
    return df.select(*keep, ds["seq"].alias("generate_seq"), ds["valid"].alias("valid"))


def in_gate(seq) -> F.Column:
    s = F.col(seq) if isinstance(seq, str) else seq
    return s.isNotNull() & F.length(s).between(MIN_LEN, MAX_LEN)


def motif_repeats_long(df: DataFrame, key: Sequence[str], text: str,
                       widths: Sequence[int] = MOTIF_WIDTHS) -> DataFrame:
    """A3 over texts of any length, one row per input row with ``repeats``.

    One path for all lengths: an Arrow-batched numpy counter packs the motifs
    of a text into codes and sorts them.  Row-local, so there is no shuffle and
    repeated or null keys change nothing; a null text gives null.
    """
    if tuple(widths) != MOTIF_WIDTHS:
        raise ValueError("the counter is built for widths 2, 3, 4")
    key = [key] if isinstance(key, str) else list(key)
    return df.select(*key, V.motif_repeats_text(F.col(text)).alias("repeats"))


def score_designs(df: DataFrame, scorer: PairScorer | None = None,
                  keep: Sequence[str] = (), text_col: str = "completion",
                  keywords: str = "keywords", reference: str = "candidate",
                  repetition: str = "as_coded", embeddings: DataFrame | None = None,
                  embedder=E.ColumnEmbedder(), inline_vectors: bool = False,
                  engine: str = "batch") -> DataFrame:
    """J09 end to end.  ``repetition``: ``as_coded`` (the reference stores the
    last reward, so the penalty is always 0) or ``running_count``."""
    t = F.col(text_col)
    cols = list(dict.fromkeys([*keep, "step", "pos", keywords, reference]))
    # blocks and think text are columns, so that each is made once a row
    fmt = format_checks(df, text_col, keep=dict.fromkeys([*cols, text_col]), blocks=True) \
        .select(*dict.fromkeys([*cols, text_col]), "format_reward",
                F.array_join("_think", " ").alias("_think"),
                T.strip(F.get("_answers", 0)).alias("_block"))
    ds = T.designed_sequence(t, F.col("_block"))
    rows = fmt.select(
        *cols, "format_reward",
        T.keyword_mention(t, keywords, design_mode=True, think=F.col("_think")).alias("mention_reward"),
        ds["seq"].alias("generate_seq"), ds["valid"].alias("valid"))

    gated = in_gate("generate_seq")
    if inline_vectors:
        # Row-local vectors from a column embedder (no join): the streaming path.
        if not isinstance(embedder, E.ColumnEmbedder):
            raise ValueError("inline_vectors needs a ColumnEmbedder")
        va, vb = embedder.fn(F.col("generate_seq")), embedder.fn(F.col(reference))
        present = va.isNotNull() & vb.isNotNull()
        with_vec = rows.select("*", F.when(present, V.vsub(va, vb)).alias("features"),
                               present.alias("has_vectors"))
    else:
        # Vectors for the distinct designs and references (cache first, J03 for
        # misses).  The vector side is derived, so its size is only known at run
        # time: leave the join to AQE (broadcast when the shuffle shows it small).
        seqs = rows.select(F.col("generate_seq").alias("seq")).unionByName(
            rows.select(F.col(reference).alias("seq")))
        vecs = E.embedding_lookup(seqs, "seq", embeddings, embedder)
        with_vec = attach_pair_vectors(rows, vecs, key_a=F.when(gated, F.col("generate_seq")),
                                       key_b=F.when(gated, F.col(reference)), broadcast=False)
    if scorer is None:
        scorer = PairScorer.by_rule(20)
    design = F.when(gated & F.col("has_vectors"), scorer.probability(F.col("features"), engine))
    diversity = N.diversity_squash(V.motif_repeats("generate_seq"))
    scored = with_vec.select(
        *cols, "format_reward", "mention_reward", "generate_seq", "valid",
        F.coalesce(design, F.lit(0.0)).alias("design_reward"),
        F.when(gated, diversity).otherwise(F.lit(0.0)).alias("diversity_reward"))

    if repetition == "as_coded":
        scored = scored.withColumn("repetition_penalty", F.lit(0.0))
    elif repetition == "running_count":
        scored = prior_counts(scored).withColumn(
            "repetition_penalty", N.repetition_penalty("prior_count"))
    else:
        raise ValueError("repetition must be 'as_coded' or 'running_count'")
    return scored.withColumn("total_reward", N.design_total(
        "format_reward", "design_reward", "diversity_reward", "mention_reward",
        "repetition_penalty"))
