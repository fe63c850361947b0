"""DuckDB twins of the registered queries (same column names and rows)."""

from __future__ import annotations

from skein.plans import sqlparts as S

ORACLE: dict[str, str] = {}

_CHECKS = S.checks("completion")
_CHECK_SQL = ",\n  ".join(f"{v} AS {k}" for k, v in _CHECKS.items())
_COMPOSITE = S.composite("completion")


def _with_completions(body: str) -> str:
    return "WITH completions AS (" + S.COMPLETIONS + ")\n" + body


ORACLE["format_checks"] = _with_completions(
    "SELECT conv_id, turn, v,\n  " + _CHECK_SQL.replace(
        _CHECKS["tagged_ratio"] + " AS tagged_ratio",
        "round(" + _CHECKS["tagged_ratio"] + ", 6) AS tagged_ratio")
    + "\nFROM completions")

ORACLE["format_composite"] = _with_completions(
    "SELECT conv_id, turn, v, round(" + _COMPOSITE + ", 6) AS format_reward FROM completions")

ORACLE["format_report"] = _with_completions(
    "SELECT v, count(*) AS n, round(avg(format_reward), 6) AS mean_format_reward, "
    + ", ".join(f"round(1 - avg({k}), 6) AS fail_{k}" for k in _CHECKS)
    + " FROM (SELECT v, " + _CHECK_SQL + ", " + _COMPOSITE
    + " AS format_reward FROM completions) c GROUP BY v")

ORACLE["binary_answer"] = _with_completions(
    "SELECT conv_id, turn, " + S.binary_answer("completion") + " AS answer FROM completions")

ORACLE["keyword_mention"] = _with_completions(
    "SELECT conv_id, turn, round(" + S.mention("completion", "keywords")
    + ", 6) AS mention_reward FROM completions")

_ANSWER = S.answer_reward("completion", "classes", "class_confidences")

ORACLE["answer_reward"] = _with_completions(
    "SELECT conv_id, turn, round(a, 6) AS answer_reward, round(" + S.asymmetric("a")
    + ", 6) AS scaled_answer_reward FROM (SELECT conv_id, turn, " + _ANSWER
    + " AS a FROM completions) x")

ORACLE["answer_total"] = _with_completions(
    "SELECT conv_id, turn, step, round(f, 6) AS format_reward, round(m, 6) AS mention_reward, "
    "round(a, 6) AS answer_reward, round(" + S.asymmetric("a") + ", 6) AS scaled_answer_reward, "
    "round(0.5 * f + 2.5 * " + S.asymmetric("a") + " + 0.5 * m, 6) AS total_reward "
    "FROM (SELECT conv_id, turn, step, " + _COMPOSITE + " AS f, "
    + S.mention("completion", "keywords") + " AS m, " + _ANSWER + " AS a FROM completions) x")


# ---- steps 3-5 --------------------------------------------------------------

_BASE = [("designs", S.DESIGNS), ("seq_vectors", S.SEQ_VECTORS), ("pairs", S.PAIRS)]
_PROMPTS = _BASE + [("pair_prompts", S.PAIR_PROMPTS)]

ORACLE["union_prompts"] = S.ctes(*_PROMPTS, ("doc_prompts", S.DOC_PROMPTS),
                                 ("design_prompts", S.DESIGN_PROMPTS)) + """
select * from pair_prompts union all by name select * from doc_prompts
union all by name select * from design_prompts"""

_SCORED_PROMPTS = """
select pp.*, (ok and ea is not null and eb is not null) as scored, ea, eb from (
  select *, string_split(keywords, '|') as parts,
    (keywords is not null and keywords <> '' and contains(keywords, '|')
     and len(string_split(keywords, '|')) >= 2) as ok
  from pair_prompts) pp
left join (select seq as ka, embedding as ea from seq_vectors) va on ok and va.ka = pp.parts[1]
left join (select seq as kb, embedding as eb from seq_vectors) vb on ok and vb.kb = pp.parts[2]
"""

_PROB = ("case when scored then 1.0 / (1.0 + exp(-(" + S.mlp_logit(S.vsub("ea", "eb"))
         + "))) else 0.5 end")

ORACLE["soft_label_prompts"] = S.ctes(*_PROMPTS, ("sp", _SCORED_PROMPTS)) + """
select pair_id, """ + S.prompt_text("system_prompt", "user_prompt") + """ as prompt,
  (p > 0.5)::INT as label, 'no|yes' as classes, printf('%.3f|%.3f', 1.0 - p, p) as class_confidences,
  keywords, task, round(p, 6) as probability, scored
from (select *, case when scored and (case when seqA_plddt > seqB_plddt then 1 else 0 end) <> label
          then 1.0 - q else q end as p
      from (select *, """ + _PROB + """ as q from sp) a) b"""

ORACLE["soft_label_given"] = S.ctes(("doc_prompts", S.DOC_PROMPTS)) + """
select doc_id, label, round(prob_score, 6) as prob_score, 'no|yes' as classes,
  case when label = 1 then printf('%.3f|%.3f', 1.0 - prob_score, prob_score)
       when label = 0 then printf('%.3f|%.3f', prob_score, 1.0 - prob_score) end
  as class_confidences
from doc_prompts"""

ORACLE["cycled_prompts"] = S.ctes(*_PROMPTS) + """
select r.replica::INT as replica, pair_id, keywords, task, label
from pair_prompts, (select unnest([0, 1]) as replica) r"""

_PAIR_VECS = """
select p.*, ea, eb, (ea is not null and eb is not null) as has_vectors
from pairs p
left join (select seq as ka, embedding as ea from seq_vectors) va on va.ka = p.seqA
left join (select seq as kb, embedding as eb from seq_vectors) vb on vb.kb = p.seqB
"""

ORACLE["pair_diff_vectors"] = S.ctes(*_BASE, ("pv", _PAIR_VECS)) + """
select pair_id, seqA, seqB, has_vectors,
  case when has_vectors then """ + S.vround(S.vsub("ea", "eb")) + """ end as features
from pv"""

ORACLE["pair_concat_vectors"] = S.ctes(*_PROMPTS) + """
select pair_id, (ea is not null and eb is not null) as has_vectors,
  case when ea is not null and eb is not null then """ + S.vround("list_concat(ea, eb)") + """ end
  as features
from (select *, string_split(keywords, '|') as parts,
    (keywords is not null and keywords <> '' and contains(keywords, '|')
     and len(string_split(keywords, '|')) >= 2) as ok from pair_prompts) pp
left join (select lower(seq) as ka, embedding as ea from seq_vectors) va
  on ok and va.ka = lower(pp.parts[1])
left join (select lower(seq) as kb, embedding as eb from seq_vectors) vb
  on ok and vb.kb = lower(pp.parts[2])"""

ORACLE["pair_target_vectors"] = S.ctes(*_BASE, ("pv", _PAIR_VECS)) + """
select pair_id, target_id, (has_vectors and et is not null) as has_vectors,
  case when has_vectors and et is not null then
    """ + S.vround("list_transform(range(len(ea)), lambda i: (ea[i+1] - eb[i+1]) + et[i+1])") + """
  end as features
from pv left join (select vec_id as tk, embedding as et from embeddings) t on t.tk = pv.target_id"""

ORACLE["pair_scores"] = S.ctes(*_BASE, ("pv", _PAIR_VECS)) + """
select pair_id, has_vectors as scored,
  round(case when has_vectors then 1.0 / (1.0 + exp(-(""" + S.mlp_logit(S.vsub("ea", "eb")) + """)))
        else 0.5 end, 6) as probability
from pv"""

ORACLE["missing_vector_count"] = S.ctes(*_BASE, ("pv", _PAIR_VECS)) + """
select count(*) as n, sum((not has_vectors)::INT)::BIGINT as invalid from pv"""

ORACLE["pair_labels"] = S.ctes(*_BASE) + """
select pair_id, seqA_plddt, seqB_plddt,
  case when seqA_plddt is null or seqB_plddt is null then null
       when seqA_plddt > seqB_plddt then 1 else 0 end::INT as label
from pairs"""

ORACLE["cycle_dedupe"] = S.ctes(("designs", S.DESIGNS), ("cycles", S.DESIGN_CYCLES)) + """
select distinct generate_seq, plddt from cycles"""

ORACLE["sampled_partners"] = S.ctes(
    ("designs", S.DESIGNS), ("cycles", S.DESIGN_CYCLES),
    ("r", "select generate_seq, max(plddt) as plddt from "
          "(select distinct generate_seq, plddt from cycles) d group by generate_seq"),
    ("ix", "select generate_seq, plddt, row_number() over (order by md5(generate_seq), "
           "generate_seq) - 1 as idx from r"),
    ("a", "select generate_seq as seqA, plddt as seqA_plddt, k::INT as k, "
          "('0x' || substr(md5('42:' || generate_seq || ':' || k::VARCHAR), 1, 15))::BIGINT "
          "% (select count(*) from r) as t from r, (select unnest(range(5)) as k) kk")) + """
select seqA, seqA_plddt, k, ix.generate_seq as seqB, ix.plddt as seqB_plddt,
  (case when seqA_plddt > ix.plddt then 1 else 0 end)::INT as label
from a join ix on ix.idx = a.t"""


# ---- steps 6-7 --------------------------------------------------------------

_GEN, _VALID = S.designed("completion")
_DC = [("designs", S.DESIGNS), ("dc", S.DESIGN_COMPLETIONS)]
_DESIGN_ROWS = """
select id, step, pos, candidate, """ + _COMPOSITE + """ as format_reward,
  """ + S.mention("completion", "keywords", design_mode=True) + """ as mention_reward,
  """ + _GEN + """ as generate_seq, """ + _VALID + """ as valid
from dc"""
_GATED = "(generate_seq is not null and length(generate_seq) between 5 and 15)"
_DESIGN_SCORED = """
select *, 0.5 * format_reward + 2.5 * design_reward + 0.25 * diversity_reward
          + 0.5 * mention_reward - 0.25 * repetition_penalty as total_reward
from (select *, case when """ + _GATED + " then " + S.sigmoid(S.mlp_logit("xv")) + """ else 0.0 end
          as design_reward,
        case when """ + _GATED + " then 1 - tanh(" + S.motif_repeats("generate_seq") + """ / 10.0)
          else 0.0 end as diversity_reward,
        0.0 as repetition_penalty
      from (select *, """ + S.vsub("cg", "cc") + """ as xv
            from (select *, """ + S.composition("generate_seq") + " as cg, " + S.composition(
    "candidate") + """ as cc from rows) r0) r1) x"""
_DESIGN_CTES = _DC + [("rows", _DESIGN_ROWS), ("scored", _DESIGN_SCORED)]

ORACLE["designed_sequences"] = S.ctes(*_DC) + (
    "select id, " + _GEN + " as generate_seq, " + _VALID + " as valid from dc")

ORACLE["motif_repetition"] = S.ctes(("designs", S.DESIGNS)) + (
    "select id, " + S.motif_repeats("seq") + "::BIGINT as repeats, round(1 - tanh("
    + S.motif_repeats("seq") + " / 10.0), 6) as diversity_reward from designs")

ORACLE["motif_repetition_text"] = """
with m as (
  select conv_id, turn, substring(text, i, w) as motif, w from (
    select conv_id, turn, text, w, unnest(range(1, length(text) - w + 2)) as i
    from (select conv_id, turn, text, unnest([2, 3, 4]) as w from conversations) a) b),
c as (select conv_id, turn, w, motif, count(*) as c from m group by all),
r as (select conv_id, turn, sum(c - 1) as repeats from c where c > 2 group by all)
select k.conv_id, k.turn, coalesce(r.repeats, 0)::BIGINT as repeats
from conversations k left join r on r.conv_id = k.conv_id and r.turn = k.turn"""

ORACLE["motif_repetition_documents"] = """
with m as (
  select doc_id, substring(text, i, w) as motif, w from (
    select doc_id, text, w, unnest(range(1, length(text) - w + 2)) as i
    from (select doc_id, text, unnest([2, 3, 4]) as w from documents) a) b),
c as (select doc_id, w, motif, count(*) as c from m group by all),
r as (select doc_id, sum(c - 1) as repeats from c where c > 2 group by all)
select k.doc_id, case when k.text is not null then coalesce(r.repeats, 0)::BIGINT end as repeats
from documents k left join r on r.doc_id = k.doc_id"""

ORACLE["residue_dominance"] = S.ctes(("designs", S.DESIGNS)) + """
select id, round(case when length(seq) > 0 then -(
  list_max(list_transform(list_distinct(string_split(seq, '')),
    lambda ch: length(seq) - length(replace(seq, ch, '')))) / length(seq)) end, 6) as dominance
from designs"""

ORACLE["plddt_reward"] = S.ctes(*_BASE) + """
select pair_id, round(case when d < 0 then 0.5 * tanh(0.04 * d)
  else d / 100 + 0.5 * tanh(0.04 * d) end, 6) as plddt_reward
from (select pair_id, seqA_plddt - seqB_plddt as d from pairs) x"""

ORACLE["design_total"] = S.ctes(*_DESIGN_CTES) + """
select id, step, pos, generate_seq, valid, round(format_reward, 6) as format_reward,
  round(mention_reward, 6) as mention_reward, round(design_reward, 6) as design_reward,
  round(diversity_reward, 6) as diversity_reward,
  round(repetition_penalty, 6) as repetition_penalty, round(total_reward, 6) as total_reward
from scored"""

ORACLE["ledger_last"] = S.ctes(*_DESIGN_CTES) + """
select generate_seq, count(*) as n,
  round(arg_max(design_reward, {'s': step, 'p': pos}), 6) as generate_seq_prob
from scored group by generate_seq"""

ORACLE["ledger_running_count"] = S.ctes(*_DESIGN_CTES) + """
select id, generate_seq, prior_count, round(pen, 6) as repetition_penalty,
  round(total_reward + 0.25 * 0.0 - 0.25 * pen, 6) as total_reward
from (select *, floor(prior_count / 4) / (floor(prior_count / 4) + 4) as pen
      from (select *, (count(*) over (partition by generate_seq order by step, pos
              rows between unbounded preceding and 1 preceding))::BIGINT as prior_count
            from scored) a) b"""

ORACLE["composition_embeddings"] = S.ctes(("designs", S.DESIGNS)) + (
    "select seq, " + S.vround(S.composition("seq")) + " as embedding "
    "from (select distinct seq from designs where seq is not null and length(seq) > 0) d")

ORACLE["new_sequences"] = S.ctes(*_DC, ("cycles", S.DESIGN_CYCLES)) + """
select seq, """ + S.vround(S.composition("seq")) + """ as embedding from (
  select distinct """ + _GEN + """ as seq from dc where """ + _VALID + """
  except select generate_seq from cycles where cycle = 0) x
where seq is not null and length(seq) > 0"""

ORACLE["mean_pool"] = """
with t as (select label as seq_key, vec_id, embedding,
             min(vec_id) over (partition by label) as lo,
             max(vec_id) over (partition by label) as hi from embeddings),
x as (select seq_key, i, avg(embedding[i]::DOUBLE) as v from (
        select seq_key, embedding, unnest(range(1, len(embedding) + 1)) as i
        from t where vec_id > lo and vec_id < hi) a group by seq_key, i)
select seq_key, list_transform(list(v order by i), lambda z: round(z, 6)) as embedding
from x group by seq_key"""

ORACLE["embedding_fingerprint"] = """
select count(*) as n, (sum(('0x' || substr(md5(cast(vec_id as varchar) || ':' ||
  array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000 + 0.5)::BIGINT),
  ',')), 1, 15))::BIGINT::HUGEINT) % 1152921504606846976)::BIGINT as fingerprint
from embeddings"""


# ---- steps 8-9 --------------------------------------------------------------

_ANSWER_SCORED = """
select *, """ + S.asymmetric("answer_reward") + """ as scaled_answer_reward,
  0.5 * format_reward + 2.5 * """ + S.asymmetric("answer_reward") + """ + 0.5 * mention_reward
  as total_reward
from (select conv_id, turn, step, pos, completion, label, """ + _COMPOSITE + """ as format_reward,
        """ + S.mention("completion", "keywords") + """ as mention_reward,
        """ + _ANSWER + """ as answer_reward from completions) x"""
_AS = S.ctes(("completions", S.COMPLETIONS), ("scored", _ANSWER_SCORED))

ORACLE["judge_votes"] = S.ctes(("completions", S.COMPLETIONS)) + """
select design_seq, ref_seq, count(*) as n_responses, sum(y)::BIGINT as n_yes,
  round(avg(y), 6) as yes_fraction
from (select cast(conv_id as varchar) as design_seq, """ + S.first_keyword("keywords") + """ as ref_seq,
        coalesce(contains(lower(""" + S.strip(
    "regexp_extract_all(completion, '(?s)<answer>(.*?)</answer>', 1)[1]") + """), 'yes'), false)::INT
        as y
      from completions) r
group by design_seq, ref_seq"""

ORACLE["judge_questions"] = S.ctes(*_DC) + """
select id, design_seq, ref_seq,
  'Target T1: would you pick candidate ' || design_seq || ' over candidate ' || ref_seq
  || '? Reply yes or no.'
  as question
from (select id, """ + _GEN + """ as design_seq, """ + S.first_keyword("keywords") + """ as ref_seq
      from dc) x
where design_seq is not null"""

ORACLE["reward_report"] = _AS + """
select step, count(*) as n, round(avg(total_reward), 6) as mean_total,
  round(min(total_reward), 6) as min_total, round(max(total_reward), 6) as max_total,
  round(stddev_samp(total_reward), 6) as std_total,
  round(quantile_disc(total_reward, 0.5), 6) as median_total,
  round(avg(format_reward), 6) as mean_format_reward,
  round(avg(mention_reward), 6) as mean_mention_reward,
  round(avg(answer_reward), 6) as mean_answer_reward
from scored group by step"""

ORACLE["reward_trace"] = _AS + """
select step, pos, conv_id, label, round(format_reward, 6) as format_reward,
  round(mention_reward, 6) as mention_reward, round(answer_reward, 6) as answer_reward,
  round(total_reward, 6) as total_reward, """ + S.binary_answer("completion") + """ as answer,
  substring(""" + S.think_text("completion") + """, 1, 100) as think_head
from scored where step % 50 = 0"""

ORACLE["group_advantage"] = _AS + """
select conv_id, turn, round(total_reward, 6) as total_reward, group_size,
  round(coalesce((total_reward - m) / (s + 0.0001), 0.0), 6) as advantage
from scored join (select conv_id as g, avg(total_reward) as m, stddev_samp(total_reward) as s,
                    count(*) as group_size from scored group by conv_id) st on st.g = conv_id"""

ORACLE["best_of_group"] = _AS + """
select conv_id, count(*) as n, arg_max(pos, {'v': total_reward, 'p': -pos}) as best_pos,
  round(max(total_reward), 6) as best_value
from scored group by conv_id"""

ORACLE["binary_metrics"] = """
with t as (select l.quality as label,
             case when length(d.text) > 0 then """ + S.words("d.text") + """ / length(d.text)
             else 0.0 end as score
           from documents d join labels l on l.doc_id = d.doc_id),
g as (select score, sum(label) as pos, sum(1 - label) as neg from t group by score),
c as (select pos, neg, coalesce(sum(neg) over (order by score rows between unbounded preceding
        and 1 preceding), 0) as below from g),
a as (select sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) as auc from c),
m as (select count(*) as n, sum(label)::BIGINT as n_pos,
        avg(((score > 0.5)::INT = label)::INT) as accuracy,
        avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15))
              + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) as log_loss,
        (sum((score > 0.5)::INT * label) / sum(label)
         + sum((1 - (score > 0.5)::INT) * (1 - label)) / sum(1 - label)) / 2 as hard_auc
      from t)
select n, n_pos, round(accuracy, 6) as accuracy, round(log_loss, 6) as log_loss,
  round(auc, 6) as auc, round(hard_auc, 6) as hard_auc
from m, a"""


# ---- step 10: streaming twins (the batch results) ----------------------------

ORACLE["stream_rewards"] = ORACLE["answer_total"]
ORACLE["stream_ledger"] = ORACLE["ledger_last"]

ORACLE["stream_running_count"] = S.ctes(*_DESIGN_CTES) + """
select id, generate_seq, (count(*) over (partition by generate_seq order by step, pos
  rows between unbounded preceding and 1 preceding))::BIGINT as prior_count
from scored"""

ORACLE["stream_windowed_report"] = """
select date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end,
  event_type, count(*) as n, round(sum(value), 6) as total_value, round(avg(value), 6) as mean_value
from events group by all"""

ORACLE["stream_rewards_resumed"] = ORACLE["stream_rewards"]
ORACLE["stream_ledger_resumed"] = ORACLE["stream_ledger"]
ORACLE["stream_windowed_report_batches"] = ORACLE["stream_windowed_report"]

ORACLE["design_examples"] = S.ctes(("designs", S.DESIGNS), ("dp", S.DESIGN_PROMPTS)) + """
select prompt_id, """ + S.prompt_text("system_prompt", "user_prompt") + """ as prompt, keywords,
  task, system_prompt, user_prompt, round(candidate_plddt, 6) as candidate_plddt, candidate
from dp"""


# ---- tables written and read back, joins and reports --------------------------

_FIRST_PROMPT = """
select conv_id, keywords, classes, class_confidences from completions
qualify row_number() over (partition by conv_id order by turn) = 1"""

ORACLE["scored_from_prompts"] = S.ctes(
    ("completions", S.COMPLETIONS), ("prompts", _FIRST_PROMPT),
    ("joined", "select c.conv_id, c.turn, c.step, c.completion, p.keywords, p.classes, p.class_confidences "
               "from completions c join prompts p on p.conv_id = c.conv_id"),
    ("x", "select conv_id, turn, step, " + _COMPOSITE + " as f, " + S.mention("completion", "keywords")
          + " as m, " + _ANSWER + " as a from joined")) + (
    "select conv_id, turn, step, round(f, 6) as format_reward, round(m, 6) as mention_reward, "
    "round(a, 6) as answer_reward, round(" + S.asymmetric("a") + ", 6) as scaled_answer_reward, "
    "round(0.5 * f + 2.5 * " + S.asymmetric("a") + " + 0.5 * m, 6) as total_reward from x")

ORACLE["prompts_from_csv"] = S.ctes(*_PROMPTS, ("doc_prompts", S.DOC_PROMPTS)) + """
select * from pair_prompts union all by name select * from doc_prompts"""

ORACLE["cycles_from_files"] = S.ctes(("designs", S.DESIGNS), ("cycles", S.DESIGN_CYCLES)) + """
select cycle::INT as cycle, generate_seq, plddt from cycles"""

ORACLE["embedding_cache"] = ORACLE["composition_embeddings"]
ORACLE["composition_embeddings_pandas"] = ORACLE["composition_embeddings"]
ORACLE["pairs_written"] = ORACLE["sampled_partners"]
ORACLE["ledger_from_batches"] = ORACLE["ledger_last"]
ORACLE["judge_votes_written"] = ORACLE["judge_votes"]
ORACLE["design_examples_written"] = ORACLE["design_examples"]
ORACLE["pair_scores_stored_weights"] = ORACLE["pair_scores"]
ORACLE["design_total_cached"] = ORACLE["design_total"]

ORACLE["training_split"] = S.ctes(*_BASE, ("pv", _PAIR_VECS)) + """
select case when ('0x' || substr(md5(pair_id::VARCHAR), 1, 8))::BIGINT % 100 < 80 then 'train'
       else 'validation' end as split, count(*) filter (has_vectors) as n,
  count(*) filter (has_vectors and seqA_plddt > seqB_plddt) as n_positive,
  count(*) filter (not has_vectors) as n_dropped
from pv group by all"""

_DESIGN_PARTS = ["format_reward", "mention_reward", "design_reward", "diversity_reward", "repetition_penalty"]

ORACLE["design_report"] = S.ctes(*_DESIGN_CTES) + """
select step, count(*) as n, round(avg(total_reward), 6) as mean_total,
  round(min(total_reward), 6) as min_total, round(max(total_reward), 6) as max_total,
  round(stddev_samp(total_reward), 6) as std_total,
  round(quantile_disc(total_reward, 0.5), 6) as median_total, """ + ", ".join(
    f"round(avg({c}), 6) as mean_{c}, round(min({c}), 6) as min_{c}, round(max({c}), 6) as max_{c}, "
    f"round(quantile_disc({c}, 0.5), 6) as approx_median_{c}" for c in _DESIGN_PARTS) + """
from scored group by step"""

_DESIGN_TRACED = S.ctes(*_DC, ("rows", _DESIGN_ROWS.replace("candidate,", "candidate, completion, keywords,")),
                        ("scored", _DESIGN_SCORED))
ORACLE["design_trace"] = _DESIGN_TRACED + """
select step, pos, id, completion, keywords, generate_seq, """ + ", ".join(
    f"round({c}, 6) as {c}" for c in [*_DESIGN_PARTS, "total_reward"]) + """,
  """ + S.binary_answer("completion") + """ as answer,
  substring(""" + S.think_text("completion") + """, 1, 100) as think_head
from scored where step % 50 = 0"""


# ---- the judge, levels, sketches, differences and order -------------------------

ORACLE["judge_sampled_votes"] = S.ctes(*_DC) + """
select design_seq, ref_seq, count(*) as n_responses, sum(y)::BIGINT as n_yes, round(avg(y), 6) as yes_fraction
from (select design_seq, ref_seq, (md5('Target T1: would you pick candidate ' || design_seq || ' over candidate '
        || ref_seq || '? Reply yes or no.' || ':' || sample) < '8')::INT as y
      from (select distinct """ + _GEN + """ as design_seq, """ + S.first_keyword("keywords") + """ as ref_seq
            from dc) q, (select unnest([0, 1, 2]) as sample) s
      where design_seq is not null and ref_seq is not null) r
group by design_seq, ref_seq"""

ORACLE["format_rollup"] = _with_completions(
    "SELECT v, step, count(*) AS n, round(avg(format_reward), 6) AS mean_format_reward, "
    + ", ".join(f"round(1 - avg({k}), 6) AS fail_{k}" for k in _CHECKS)
    + ", grouping(v, step)::BIGINT AS grouping_id, (grouping(v) + grouping(step))::INT AS level"
    + " FROM (SELECT v, step, " + _CHECK_SQL + ", " + _COMPOSITE
    + " AS format_reward FROM completions) c GROUP BY ROLLUP (v, step)")

ORACLE["reward_quantiles"] = _AS + """
select step // 10 as tens, count(*) as n, round(avg(total_reward), 6) as mean_total_reward,
  round(min(total_reward), 6) as min_total_reward, round(max(total_reward), 6) as max_total_reward, """ + ", ".join(
    f"round(quantile_disc(total_reward, {q / 100}), 6) as q{q}_total_reward" for q in (10, 50, 90)) + """
from scored group by step // 10"""

ORACLE["embedding_diff"] = S.ctes(
    ("designs", S.DESIGNS),
    ("rows", "select id, seq, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000 + 0.5)) as q "
             "from designs join embeddings on vec_id = id"),
    ("old", "select seq, arg_min(q, id) as q from rows where id % 3 < 2 group by seq"),
    ("new", "select seq, arg_max(q, id) as q from rows where id % 3 > 0 group by seq")) + """
select coalesce(old.seq, new.seq) as key,
  case when old.seq is null then 'added' when new.seq is null then 'removed' else 'changed' end as change
from old full join new on old.seq = new.seq
where old.q is distinct from new.q"""

_SUFFIX = "\n You will provide the reasoning step-by-step, using detailed biological knowledge from the training."
ORACLE["ordered_scoring_copy"] = S.ctes(*_PROMPTS) + """
select replica * n + row as position, replica::INT as replica, row, pair_id,
  """ + S.prompt_text("system_prompt", "user_prompt") + """ as prompt,
  """ + S.prompt_text("system_prompt || '" + _SUFFIX + "'", "user_prompt") + """ as scoring_prompt
from (select *, row_number() over (order by pair_id) - 1 as row, count(*) over () as n from pair_prompts) p,
  (select unnest([0, 1]) as replica) r"""


# ---- streams that keep late rows (the batch results) ------------------------------

ORACLE["stream_windowed_report_watermarked"] = ORACLE["stream_windowed_report"]
ORACLE["stream_prompts_joined"] = ORACLE["scored_from_prompts"]

ORACLE["stream_sessions"] = """
select user_id, min(ts) as session_start, max(ts) + interval 12 hours as session_end, count(*) as n,
  round(sum(value), 6) as total_value
from (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as island
      from (select user_id, ts, value, coalesce(ts > lag(ts) over (partition by user_id order by ts)
              + interval 12 hours, true)::INT as fresh from events where ts is not null) a) b
group by user_id, island"""

ORACLE["embedding_cache_bucketed"] = ORACLE["composition_embeddings"]
ORACLE["pair_vectors_from_cache"] = ORACLE["pair_diff_vectors"]
