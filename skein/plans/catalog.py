"""The registered queries: name → callable(spark, sf_dir) → DataFrame.

Each query reads the input tables (through the fixture recipes) and runs one
job of the toolkit over all of their rows.  Doubles are rounded to six
places at the very end so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from skein.functions import numeric as NU
from skein.functions import vectors as FV
from skein.functions.text import RESIDUES
from skein.operators import answers, cache, formatting, network
from skein.operators import classifier as CL
from skein.operators import designs as DS
from skein.operators import embed as EM
from skein.operators import fingerprint as FP
from skein.operators import judge as JU
from skein.operators import ledger as LG
from skein.operators import metrics as ME
from skein.operators import pairs as PR
from skein.operators import prompts as PM
from skein.operators import report as RP
from skein.operators import scoring as SC
from skein.operators import vectors as VE
from skein.operators import votes as VO
from skein.schemas import CYCLE_SCHEMA
from skein.sources import fixtures as fx
from skein.sources.prompts import read_cycles, read_prompt_files, union_by_name
from skein.streaming import rewards as STR

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (and double arrays) for comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), digits)
        elif getattr(f.dataType, "elementType", None) is not None and isinstance(
                f.dataType.elementType, (DoubleType, FloatType)):
            c = F.transform(c, lambda x: F.round(x.cast("double"), digits))
        out.append(c.alias(f.name))
    return df.select(*out)


# ---- step 1: format checks ------------------------------------------------

@register("format_checks")
def format_checks(spark, sf):
    comp = fx.completions(spark, sf)
    out = formatting.format_checks(comp, keep=["conv_id", "turn", "v"])
    return round_doubles(out.drop("format_reward"))


@register("format_composite")
def format_composite(spark, sf):
    comp = fx.completions(spark, sf)
    out = formatting.format_checks(comp, keep=["conv_id", "turn", "v"])
    return round_doubles(out.select("conv_id", "turn", "v", "format_reward"))


@register("format_report")
def format_report(spark, sf):
    comp = fx.completions(spark, sf)
    checked = formatting.format_checks(comp, keep=["v"])
    return round_doubles(formatting.format_report(checked, by=["v"]))


# ---- step 2: answer-mode scoring --------------------------------------------

@register("binary_answer")
def binary_answer(spark, sf):
    comp = fx.completions(spark, sf)
    return answers.binary_answers(comp, keep=["conv_id", "turn"])


@register("keyword_mention")
def keyword_mention(spark, sf):
    from skein.functions.text import keyword_mention as km
    comp = fx.completions(spark, sf)
    return round_doubles(comp.select(
        "conv_id", "turn", km(F.col("completion"), "keywords").alias("mention_reward")))


@register("answer_reward")
def answer_reward(spark, sf):
    comp = fx.completions(spark, sf)
    out = answers.score_answers(comp, keep=["conv_id", "turn"])
    return round_doubles(out.select("conv_id", "turn", "answer_reward",
                                    "scaled_answer_reward"))


@register("answer_total")
def answer_total(spark, sf):
    comp = fx.completions(spark, sf)
    out = answers.score_answers(comp, keep=["conv_id", "turn", "step"])
    return round_doubles(out)


# ---- step 3: prompts --------------------------------------------------------


@register("union_prompts")
def union_prompts(spark, sf):
    parts = [fx.pair_prompts(spark, sf), fx.doc_prompts(spark, sf), fx.design_prompts(spark, sf)]
    return round_doubles(union_by_name(parts))


def _scored_pair_prompts(spark, sf):
    prompts = fx.pair_prompts(spark, sf)
    a, b, ok = SC.keyword_pair("keywords")
    vec = VE.attach_pair_vectors(prompts, fx.seq_vectors(spark, sf),
                                 key_a=F.when(ok, a), key_b=F.when(ok, b))
    scorer = SC.PairScorer.by_rule(64)
    return SC.score_pairs(vec, scorer, label="label")


@register("soft_label_prompts")
def soft_label_prompts(spark, sf):
    out = PM.soft_label_from_probability(_scored_pair_prompts(spark, sf))
    return round_doubles(out.select(
        "pair_id", "prompt", F.col("soft_label").alias("label"), "classes",
        "class_confidences", "keywords", "task", "probability", "scored"))


@register("soft_label_given")
def soft_label_given(spark, sf):
    out = PM.soft_label_given(fx.doc_prompts(spark, sf))
    return round_doubles(out.select("doc_id", "label", "prob_score", "classes",
                                    "class_confidences"))


@register("cycled_prompts")
def cycled_prompts(spark, sf):
    out = PM.cycle_prompts(fx.pair_prompts(spark, sf), balance=True)
    return out.select("replica", "pair_id", "keywords", "task", "label")


# ---- step 4: pair vectors and scores ------------------------------------------

def _pairs_with_target(spark, sf):
    return fx.pairs(spark, sf).join(
        fx.designs(spark, sf).select(F.col("id").alias("pair_id"),
                                     F.col("label").alias("target_id")), "pair_id")


@register("pair_diff_vectors")
def pair_diff_vectors(spark, sf):
    out = VE.attach_pair_vectors(fx.pairs(spark, sf), fx.seq_vectors(spark, sf))
    return round_doubles(out.select("pair_id", "seqA", "seqB", "has_vectors", "features"))


@register("pair_concat_vectors")
def pair_concat_vectors(spark, sf):
    genes = fx.seq_vectors(spark, sf).select(F.lower("seq").alias("seq"), "embedding")
    prompts = fx.pair_prompts(spark, sf)
    a, b, ok = SC.keyword_pair("keywords")
    out = VE.attach_pair_vectors(prompts, genes, key_a=F.when(ok, a), key_b=F.when(ok, b),
                                 mode="concat", lower_probe=True)
    return round_doubles(out.select("pair_id", "has_vectors", "features"))


@register("pair_target_vectors")
def pair_target_vectors(spark, sf):
    targets = read_table_cols(spark, sf, "embeddings", F.col("vec_id").alias("target_id"),
                              "embedding")
    out = VE.attach_pair_vectors(_pairs_with_target(spark, sf), fx.seq_vectors(spark, sf),
                                 mode="diff_plus_target", targets=targets)
    return round_doubles(out.select("pair_id", "target_id", "has_vectors", "features"))


@register("pair_scores")
def pair_scores(spark, sf):
    vec = VE.attach_pair_vectors(fx.pairs(spark, sf), fx.seq_vectors(spark, sf))
    out = SC.score_pairs(vec, SC.PairScorer.by_rule(64))
    return round_doubles(out.select("pair_id", "scored", "probability"))


@register("missing_vector_count")
def missing_vector_count(spark, sf):
    vec = VE.attach_pair_vectors(fx.pairs(spark, sf), fx.seq_vectors(spark, sf))
    return VE.missing_vector_count(vec)


def read_table_cols(spark, sf, name, *cols):
    from skein.sources.tables import read_table
    return read_table(spark, sf, name).select(*cols)


# ---- step 5: pairs from design cycles -----------------------------------------

@register("pair_labels")
def pair_labels(spark, sf):
    p = fx.pairs(spark, sf)
    return p.select("pair_id", "seqA_plddt", "seqB_plddt", PR.pair_label().alias("label"))


@register("cycle_dedupe")
def cycle_dedupe(spark, sf):
    return PR.dedupe_cycles(fx.design_cycles(spark, sf))


@register("sampled_partners")
def sampled_partners(spark, sf):
    return PR.cycle_pairs(fx.design_cycles(spark, sf), resolve="max")


# ---- step 6: design scoring and the ledger ------------------------------------


_DESIGN_OUT = ["id", "step", "pos", "generate_seq", "valid", "format_reward", "mention_reward",
               "design_reward", "diversity_reward", "repetition_penalty", "total_reward"]


@register("designed_sequences")
def designed_sequences(spark, sf):
    return DS.designed_sequences(fx.design_completions(spark, sf), keep=["id"])


@register("motif_repetition")
def motif_repetition(spark, sf):
    d = fx.designs(spark, sf)
    r = FV.motif_repeats("seq")
    return round_doubles(d.select("id", r.cast("long").alias("repeats"),
                                  NU.diversity_squash(r).alias("diversity_reward")))


@register("motif_repetition_text")
def motif_repetition_text(spark, sf):
    conv = read_table_cols(spark, sf, "conversations", "conv_id", "turn", "text")
    return DS.motif_repeats_long(conv, ["conv_id", "turn"], "text")


@register("motif_repetition_documents")
def motif_repetition_documents(spark, sf):
    docs = read_table_cols(spark, sf, "documents", "doc_id", "text")
    return DS.motif_repeats_long(docs, "doc_id", "text")


@register("residue_dominance")
def residue_dominance(spark, sf):
    d = fx.designs(spark, sf)
    return round_doubles(d.select("id", FV.residue_dominance("seq").alias("dominance")))


@register("plddt_reward")
def plddt_reward(spark, sf):
    p = fx.pairs(spark, sf)
    return round_doubles(p.select("pair_id", NU.plddt_reward("seqA_plddt", "seqB_plddt")
                                  .alias("plddt_reward")))


@register("design_total")
def design_total(spark, sf):
    out = DS.score_designs(fx.design_completions(spark, sf), keep=["id"])
    return round_doubles(out.select(*_DESIGN_OUT))


@register("ledger_last")
def ledger_last(spark, sf):
    scored = DS.score_designs(fx.design_completions(spark, sf), keep=["id"])
    return round_doubles(LG.last_scores(scored))


@register("ledger_running_count")
def ledger_running_count(spark, sf):
    out = DS.score_designs(fx.design_completions(spark, sf), keep=["id"],
                           repetition="running_count")
    return round_doubles(out.select("id", "generate_seq", "prior_count", "repetition_penalty",
                                    "total_reward"))


# ---- step 7: embeddings and the fingerprint -----------------------------------

@register("composition_embeddings")
def composition_embeddings(spark, sf):
    return round_doubles(EM.embed_sequences(fx.designs(spark, sf), "seq"))


@register("new_sequences")
def new_sequences(spark, sf):
    cycles = fx.design_cycles(spark, sf)
    cache = EM.embed_sequences(cycles.filter(F.col("cycle") == 0), "generate_seq")
    designed = DS.designed_sequences(fx.design_completions(spark, sf)).filter(F.col("valid"))
    return round_doubles(EM.embed_sequences(designed, "generate_seq", cache=cache))


@register("mean_pool")
def mean_pool(spark, sf):
    return round_doubles(EM.mean_pool(fx.token_vectors(spark, sf)))


@register("embedding_fingerprint")
def embedding_fingerprint(spark, sf):
    e = read_table_cols(spark, sf, "embeddings", F.col("vec_id").cast("string").alias("seq"),
                        "embedding")
    return FP.table_fingerprint(e)


# ---- step 8: votes, reports, group advantage ----------------------------------


JUDGE_TARGET = "T1"


def _answer_scored(spark, sf):
    comp = fx.completions(spark, sf)
    return answers.score_answers(comp, keep=["conv_id", "turn", "step", "pos", "completion",
                                             "label"])


@register("judge_votes")
def judge_votes(spark, sf):
    return round_doubles(VO.vote_shares(fx.judge_responses(spark, sf)))


@register("judge_questions")
def judge_questions(spark, sf):
    return VO.judge_requests(fx.design_completions(spark, sf), JUDGE_TARGET, keep=["id"])


@register("reward_report")
def reward_report(spark, sf):
    return round_doubles(RP.reward_report(_answer_scored(spark, sf), by=["step"]))


@register("reward_trace")
def reward_trace(spark, sf):
    cols = ["step", "pos", "conv_id", "label", "format_reward", "mention_reward",
            "answer_reward", "total_reward"]
    return round_doubles(RP.reward_trace(_answer_scored(spark, sf), cols=cols))


@register("group_advantage")
def group_advantage(spark, sf):
    out = RP.group_advantage(_answer_scored(spark, sf), ["conv_id"])
    return round_doubles(out.select("conv_id", "turn", "total_reward", "group_size",
                                    "advantage"))


@register("best_of_group")
def best_of_group(spark, sf):
    return round_doubles(RP.best_of_group(_answer_scored(spark, sf), ["conv_id"]))


# ---- step 9: evaluation and training ------------------------------------------

def _doc_scores(spark, sf):
    from skein.functions.text import word_count
    from skein.sources.tables import read_table
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    n = F.length("text")
    score = F.when(n > 0, word_count("text") / n).otherwise(F.lit(0.0))
    return docs.join(lab, "doc_id").select(F.col("quality").alias("label"),
                                           score.alias("score"))


@register("binary_metrics")
def binary_metrics(spark, sf):
    return round_doubles(ME.binary_metrics(_doc_scores(spark, sf)))


@register("train_pair_classifier")
def train_pair_classifier(spark, sf):
    vec = VE.attach_pair_vectors(fx.pairs(spark, sf), fx.seq_vectors(spark, sf))
    vec = vec.withColumn("label", PR.pair_label())
    _, metrics = CL.train_and_evaluate(vec, "pair_id", 64)
    return round_doubles(metrics)


# ---- step 10: streaming --------------------------------------------------------


@register("stream_rewards")
def stream_rewards(spark, sf):
    return round_doubles(STR.stream_answer_scores(spark, sf))


@register("stream_ledger")
def stream_ledger(spark, sf):
    return round_doubles(STR.stream_ledger(spark, sf))


@register("stream_running_count")
def stream_running_count(spark, sf):
    return STR.stream_running_count(spark, sf)


@register("stream_windowed_report")
def stream_windowed_report(spark, sf):
    return round_doubles(STR.stream_windowed_report(spark, sf))


@register("design_examples")
def design_examples(spark, sf):
    return round_doubles(PM.design_examples(fx.design_prompts(spark, sf)))


@register("stream_rewards_resumed")
def stream_rewards_resumed(spark, sf):
    return round_doubles(STR.stream_rewards_resumed(spark, sf))


@register("stream_ledger_resumed")
def stream_ledger_resumed(spark, sf):
    return round_doubles(STR.stream_ledger_resumed(spark, sf))


@register("stream_windowed_report_batches")
def stream_windowed_report_batches(spark, sf):
    return round_doubles(STR.stream_windowed_report_batches(spark, sf))


# ---- tables written and read back, joins and reports a user runs --------------


def _folder(spark, name: str) -> str:
    from skein.session import scratch_path
    return scratch_path(spark, name)


@register("scored_from_prompts")
def scored_from_prompts(spark, sf):
    """JN10: one prompt per conversation (of its first turn), many completions."""
    comp = fx.completions(spark, sf)
    fields = ["keywords", "classes", "class_confidences"]
    prompts = comp.groupBy("conv_id").agg(F.min_by(F.struct(*fields), "turn").alias("p")) \
        .select("conv_id", "p.*")
    joined = answers.attach_prompts(comp.drop(*fields), prompts, "conv_id")
    return round_doubles(answers.score_answers(joined, keep=["conv_id", "turn", "step"]))


@register("prompts_from_csv")
def prompts_from_csv(spark, sf):
    """Two prompt tables as CSV with their own headers, read by name."""
    paths = []
    for name, frame in (("pairs", fx.pair_prompts(spark, sf)), ("docs", fx.doc_prompts(spark, sf))):
        paths.append(f"{_folder(spark, 'prompts')}/{name}.csv")
        frame.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                            ignoreTrailingWhiteSpace=False).csv(paths[-1])
    out = read_prompt_files(spark, paths)
    return round_doubles(out.withColumns({c: F.col(c).cast("long") for c in ("pair_id", "doc_id")}))


@register("cycles_from_files")
def cycles_from_files(spark, sf):
    """Files of one name in a folder per cycle."""
    cycles, base = fx.design_cycles(spark, sf), _folder(spark, "cycles")
    paths = {c: f"{base}/c{c}/designs.csv" for c in range(3)}
    for c, path in paths.items():
        cycles.filter(F.col("cycle") == c).select("generate_seq", "plddt") \
            .write.option("header", True).csv(path)
    return round_doubles(read_cycles(spark, paths, CYCLE_SCHEMA))


@register("embedding_cache")
def embedding_cache(spark, sf):
    """Two runs append to one cache, the second only what it lacks."""
    cycles, path = fx.design_cycles(spark, sf), f"{_folder(spark, 'cache')}/embeddings"
    EM.append_embeddings(EM.embed_sequences(cycles.filter("cycle = 0"), "generate_seq"), path)
    EM.append_embeddings(EM.embed_sequences(cycles, "generate_seq", cache=spark.read.parquet(path)), path)
    return round_doubles(spark.read.parquet(path))


def _composition_batch(seqs: list[str]) -> list[list[float]]:
    return [[s.count(a) / len(s) for a in RESIDUES] for s in seqs]


@register("composition_embeddings_pandas")
def composition_embeddings_pandas(spark, sf):
    """The embedder plug-in over Arrow batches."""
    return round_doubles(EM.embed_sequences(fx.designs(spark, sf), "seq",
                                            embedder=EM.PandasEmbedder(_composition_batch)))


@register("pairs_written")
def pairs_written(spark, sf):
    """The pair table written and read back."""
    path = f"{_folder(spark, 'pairs')}/pairs"
    PR.write_pairs(PR.cycle_pairs(fx.design_cycles(spark, sf), resolve="max"), path)
    return spark.read.parquet(path)


@register("ledger_from_batches")
def ledger_from_batches(spark, sf):
    """Scored designs appended in two batches, the ledger written as a snapshot."""
    base = _folder(spark, "ledger")
    scored = DS.score_designs(fx.design_completions(spark, sf), keep=["id"])
    half = F.pmod(F.col("step"), F.lit(2))
    for k in range(2):
        LG.append_scored(scored.filter(half == k), f"{base}/scored")
    LG.write_snapshot(LG.last_scores(spark.read.parquet(f"{base}/scored")), f"{base}/snapshot")
    return round_doubles(spark.read.parquet(f"{base}/snapshot"))


@register("judge_votes_written")
def judge_votes_written(spark, sf):
    """Judge responses appended, votes counted from the table."""
    path = f"{_folder(spark, 'votes')}/responses"
    VO.append_responses(fx.judge_responses(spark, sf), path)
    return round_doubles(VO.vote_shares(spark.read.parquet(path)))


@register("design_examples_written")
def design_examples_written(spark, sf):
    """Examples emitted as JSON lines and read back."""
    path = f"{_folder(spark, 'examples')}/examples"
    examples = PM.design_examples(fx.design_prompts(spark, sf))
    PM.write_examples(examples, path, fmt="json")
    return round_doubles(spark.read.schema(examples.schema).json(path))


@register("pair_scores_stored_weights")
def pair_scores_stored_weights(spark, sf):
    """The scorer's weights written as a table and applied from it."""
    path = f"{_folder(spark, 'scorer')}/weights"
    SC.PairScorer.by_rule(64).to_table(spark).write.parquet(path)
    vec = VE.attach_pair_vectors(fx.pairs(spark, sf), fx.seq_vectors(spark, sf))
    out = SC.score_pairs(vec, SC.PairScorer.from_table(spark.read.parquet(path)))
    return round_doubles(out.select("pair_id", "scored", "probability"))


@register("design_total_cached")
def design_total_cached(spark, sf):
    """JN7: designs scored against a cache that holds one cycle's vectors."""
    path = f"{_folder(spark, 'cache')}/embeddings"
    EM.append_embeddings(EM.embed_sequences(fx.design_cycles(spark, sf).filter("cycle = 0"), "generate_seq"), path)
    out = DS.score_designs(fx.design_completions(spark, sf), keep=["id"],
                           embeddings=spark.read.parquet(path))
    return round_doubles(out.select(*_DESIGN_OUT))


@register("training_split")
def training_split(spark, sf):
    """JN3: rows, positives and rows dropped for want of a vector, by split."""
    vec = VE.attach_pair_vectors(fx.pairs(spark, sf), fx.seq_vectors(spark, sf))
    return CL.split_report(vec.withColumn("label", PR.pair_label()), "pair_id")


_DESIGN_PARTS = ("format_reward", "mention_reward", "design_reward", "diversity_reward", "repetition_penalty")


@register("design_report")
def design_report(spark, sf):
    """A15 in design mode, with the spread of every component."""
    scored = DS.score_designs(fx.design_completions(spark, sf), keep=["id"])
    return round_doubles(RP.reward_report(scored, by=["step"], components=_DESIGN_PARTS, spread=True))


@register("design_trace")
def design_trace(spark, sf):
    """S10 in design mode: every 50th step with its completion and parts."""
    comp = fx.design_completions(spark, sf)
    scored = DS.score_designs(comp, keep=["id", "completion"])
    return round_doubles(RP.reward_trace(scored, cols=["step", "pos", "id", "completion", "keywords", "generate_seq",
                                                       *_DESIGN_PARTS, "total_reward"]))


# ---- the judge, levels, sketches, differences and order -------------------------


@register("judge_sampled_votes")
def judge_sampled_votes(spark, sf):
    """P14 to S8 to A2 with the judge in it: a first run takes one sample a request, a
    second one takes the samples that the table lacks, and votes are counted."""
    path = f"{_folder(spark, 'judge')}/responses"
    requests = VO.judge_requests(fx.design_completions(spark, sf), JUDGE_TARGET)
    JU.judge_into(requests, path, samples=1)
    return round_doubles(VO.vote_shares(JU.judge_into(requests, path)))


@register("format_rollup")
def format_rollup(spark, sf):
    checked = formatting.format_checks(fx.completions(spark, sf), keep=["v", "step"])
    return round_doubles(formatting.format_rollup(checked, by=["v", "step"]))


@register("reward_quantiles")
def reward_quantiles(spark, sf):
    """A15 from sketches: kept per step, merged to tens of steps without their rows."""
    path = f"{_folder(spark, 'sketches')}/steps"
    RP.reward_sketches(_answer_scored(spark, sf)).write.parquet(path)
    tens = spark.read.parquet(path).withColumn("tens", F.floor(F.col("step") / 10))
    return round_doubles(RP.merged_report(tens, by=["tens"]))


@register("embedding_diff")
def embedding_diff(spark, sf):
    """What a second run changed in an embedding table.  The first run has the
    designs of cycles 0 and 1 with the vectors of their lowest ids, the second those
    of cycles 1 and 2 with the vectors of their highest ids."""
    rows = fx.designs(spark, sf).select("id", "seq").join(
        read_table_cols(spark, sf, "embeddings", F.col("vec_id").alias("id"), "embedding"), "id")
    cycle, base = F.col("id") % 3, _folder(spark, "trees")
    tables = {"old": rows.filter(cycle < 2).groupBy("seq").agg(F.min_by("embedding", "id").alias("embedding")),
              "new": rows.filter(cycle > 0).groupBy("seq").agg(F.max_by("embedding", "id").alias("embedding"))}
    for name, table in tables.items():
        FP.hash_tree(table).write.parquet(f"{base}/{name}")
    return FP.table_diff(*tables.values(), *(spark.read.parquet(f"{base}/{name}") for name in tables))


@register("ordered_scoring_copy")
def ordered_scoring_copy(spark, sf):
    """Prompts from several files, in their order, the table then the table
    again, each with the plain prompt and the scoring copy of it."""
    path = f"{_folder(spark, 'ordered')}/prompts"
    fx.pair_prompts(spark, sf).repartitionByRange(5, "pair_id").sortWithinPartitions("pair_id").write.parquet(path)
    rows = PM.scoring_copy(PM.ordered_cycle(PM.read_in_order(spark, path)))
    return rows.select("position", "replica", "row", "pair_id", "prompt", "scoring_prompt")


# ---- streams that keep late rows ------------------------------------------------


@register("stream_windowed_report_watermarked")
def stream_windowed_report_watermarked(spark, sf):
    return round_doubles(STR.stream_windowed_report_watermarked(spark, sf))


@register("stream_sessions")
def stream_sessions(spark, sf):
    return round_doubles(STR.stream_sessions(spark, sf))


@register("stream_prompts_joined")
def stream_prompts_joined(spark, sf):
    return round_doubles(STR.stream_prompts_joined(spark, sf))


# ---- the bucketed cache and the trained network -----------------------------------


def _new_name() -> str:
    import uuid
    return f"skein_vectors_{uuid.uuid4().hex[:12]}"


@register("embedding_cache_bucketed")
def embedding_cache_bucketed(spark, sf):
    """S3-S5 over a bucketed table: a second run computes only what the first left."""
    cycles, name, path = fx.design_cycles(spark, sf), _new_name(), f"{_folder(spark, 'cache')}/vectors"
    cache.embed_into(cycles.filter("cycle = 0"), name, path, "generate_seq", buckets=8)
    return round_doubles(cache.embed_into(cycles, name, path, "generate_seq", buckets=8))


@register("pair_vectors_from_cache")
def pair_vectors_from_cache(spark, sf):
    """JN1: the vectors of all pairs' sequences from a bucketed cache."""
    pairs, name, path = fx.pairs(spark, sf), _new_name(), f"{_folder(spark, 'cache')}/vectors"
    table = cache.append_to_cache(fx.seq_vectors(spark, sf), name, path, buckets=8)
    asked = pairs.select(F.explode(F.array("seqA", "seqB")).alias("seq"))
    out = VE.attach_pair_vectors(pairs, cache.cached_vectors(asked, table), broadcast=False)
    return round_doubles(out.select("pair_id", "seqA", "seqB", "has_vectors", "features"))


@register("train_pair_network")
def train_pair_network(spark, sf):
    """J12 with the ReLU network and Adam: metrics of both splits."""
    vec = VE.attach_pair_vectors(fx.pairs(spark, sf), fx.seq_vectors(spark, sf)).withColumn("label", PR.pair_label())
    return round_doubles(network.train_and_evaluate(vec, "pair_id", 64)[1])
