"""DuckDB SQL building blocks for the oracle twins.

These restate the rules independently in DuckDB SQL (RE2 regexes have no
backreferences, so the block patterns use alternation; word counts use the
same Unicode class).  They are the yardstick, not the implementation.
"""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]+"
WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
RESIDUES = "ARNDCEQGHILKMFPSTWYV"


def strip(x: str) -> str:
    return "regexp_replace(" + x + r", '\A" + WS + r"+|" + WS + r"+\z', '', 'g')"


def words(x: str) -> str:
    return "len(regexp_extract_all(" + x + ", '" + WORD + "'))"


def think_text(c: str) -> str:
    return "array_to_string(regexp_extract_all(" + c + ", '(?is)<think>(.*?)</think>', 1), ' ')"


def blocks(c: str, flags: str) -> str:
    return ("regexp_extract_all(" + c + ", '(?" + flags
            + ")<think>.*?</think>|<answer>.*?</answer>')")


def checks(c: str) -> dict[str, str]:
    has_think = "regexp_matches(" + c + ", '(?i)<think>')::INT"
    has_tag = "regexp_matches(" + c + ", '(?i)<(think|answer)>')::INT"
    total = words("regexp_replace(" + c + ", '</?(think|answer)>', '', 'g')")
    bl = blocks(c, "s")
    tagged = "(" + words("array_to_string(" + bl + ", ' ')") + " - 2 * len(" + bl + "))"
    ratio = "(case when " + total + " > 0 then " + tagged + " / " + total + " else 0.0 end)"
    sa = "regexp_split_to_array(" + c + ", '(?i)<answer>')"
    st = "regexp_split_to_array(" + c + ", '(?i)</think>')"
    after = ("(case when len(" + sa + ") > 1 and len(" + st + ") > 1 and length(" + sa
             + "[1]) > length(" + c + ") - length(" + st + "[-1]) then 1 else 0 end)")
    think_ok = "(length(" + strip(think_text(c)) + ") > 10)::INT"
    nested = ("(len(list_filter(" + blocks(c, "is") + ", lambda b: len(regexp_extract_all(b, "
              "'(?i)</?(think|answer)>')) > 2)) = 0)::INT")
    fold = ("list_reduce(regexp_extract_all(" + c + ", '(?i)</?(?:think|answer)>'), "
            "lambda st, g: case when st is null then null "
            "when g[1:2] = '</' then case when st[-1] = g[3:length(g)-1] "
            "then st[1:len(st)-1] else null end "
            "else list_append(st, g[2:length(g)-1]) end, []::VARCHAR[])")
    closed = "coalesce(len(" + fold + ") = 0, false)::INT"
    s = strip(c)
    return {
        "has_think": has_think,
        "tagged_ratio": ratio,
        "not_too_long": "(" + words(c) + " <= 200)::INT",
        "one_answer": "(len(regexp_extract_all(" + c + ", '(?i)<answer>')) = 1)::INT",
        "answer_after_thinks": after,
        "thinks_have_text": "(" + think_ok + " * " + has_think + ")",
        "no_nested_tags": "(" + nested + " * " + has_tag + ")",
        "limited_thinks": "((len(regexp_extract_all(" + c + ", '(?i)<think>')) <= 3)::INT * "
                          + has_think + ")",
        "tags_closed": "(" + closed + " * " + has_tag + ")",
        "ends_with_answer": "ends_with(" + s + ", '</answer>')::INT",
        "starts_with_think": "starts_with(" + s + ", '<think>')::INT",
    }


def composite(c: str) -> str:
    ch = checks(c)
    return "((" + " + ".join(ch.values()) + ") / 11.0)"


def binary_answer(c: str) -> str:
    first = "lower(regexp_extract_all(" + c + ", '(?is)<answer>(.*?)</answer>', 1)[1])"
    whole = "lower(" + c + ")"
    return ("(case when contains(" + first + ", 'yes') then true "
            "when contains(" + first + ", 'no') then false "
            "when contains(" + whole + ", 'yes') and not contains(" + whole + ", 'no') then true "
            "when contains(" + whole + ", 'no') and not contains(" + whole + ", 'yes') then false "
            "end)")


def keyword_list(k: str) -> str:
    return "list_filter(string_split(coalesce(" + k + ", ''), '|'), lambda x: x <> '')"


def mention(c: str, k: str, design_mode: bool = False) -> str:
    kw = keyword_list(k)
    tt = think_text(c)
    found = "len(list_filter(" + kw + ", lambda kk: contains(" + tt + ", kk)))"
    share = found + " / len(" + kw + ")"
    if design_mode:
        share = "(case when " + found + " = 1 then 1.0 else " + share + " end)"
    return ("(case when len(" + kw + ") = 0 then 1.0 when " + tt + " = '' then 0.0 else "
            + share + " end)")


def answer_reward(c: str, classes: str, conf: str) -> str:
    ans = binary_answer(c)
    word = "(case when " + ans + " then 'yes' when not " + ans + " then 'no' end)"
    cls = "list_transform(string_split(" + classes + ", '|'), lambda x: lower(" + strip("x") + "))"
    idx = "list_position(" + cls + ", " + word + ")"
    val = "string_split(" + conf + ", '|')[" + idx + "]::DOUBLE"
    return "coalesce(case when " + idx + " > 0 then " + val + " end, 0.0)"


def asymmetric(x: str) -> str:
    return ("(case when " + x + " < 0.5 then 0.5 * pow((" + x + " - 0.0) / 0.5, 1.3) "
            "else 0.5 + 0.5 * pow((" + x + " - 0.5) / 0.5, 0.7) end)")


def first_keyword(k: str) -> str:
    return keyword_list(k) + "[1]"


def fmt3(x: str) -> str:
    return ("(case when " + x + " = 1000 then '1.000' else '0.' || lpad(CAST(" + x
            + " AS VARCHAR), 3, '0') end)")


COMPLETIONS = """
select conv_id, turn, (conv_id*3+turn)%10 as v,
 case (conv_id*3+turn)%10
  when 2 then '<think>'||text||'</think><answer>'||ans||'</answer>'
  when 3 then '<Think>'||text||'</think> <answer>'||ans||'</answer>'
  when 4 then text||' '||ans
  when 5 then '<think>'||text||' <answer>'||ans||'</answer></think>'
  when 6 then '<think>a</think> <think>b</think> <think>c</think> <think>'||text||'</think> <answer>'||ans||'</answer>'
  when 7 then '<answer>'||ans||'</answer> <think>'||text||'</think>'
  when 8 then '<think>'||repeat(text||' ',3)||'</think> <answer>'||ans||'</answer>'
  when 9 then '<think>'||text||'</think> <answer>'||ans
  else '<think>'||text||'</think> <answer>'||ans||'</answer>' end as completion,
 case when conv_id%7=0 then ''
      when conv_id%2=0 then split_part(text,' ',1)||'|'||split_part(text,' ',3)
      else 'zzz|'||split_part(text,' ',2) end as keywords,
 case when conv_id%5=0 then ' YES | no' when conv_id%9=0 then 'maybe|no|yes'
      else 'no|yes' end as classes,
 """ + fmt3("(1000-k)") + " || '|' || " + fmt3("k") + """ as class_confidences,
 (k > 500)::INT as label, conv_id // 2 as step, turn as pos
from (select *, case (conv_id+turn)%4 when 0 then 'yes' when 1 then 'no'
        when 2 then 'Yes, likely' else 'unknown' end as ans,
        (conv_id*37+turn*11)%1001 as k
      from conversations where role='assistant') b
"""


DESIGNS = """
select id, case when id%11=0 then lower(s) when id%5=0 then repeat(substr(s,1,2),6)
  else s end as seq, (50+5*label)::DOUBLE as plddt, label
from (select vec_id as id, label,
        translate(substr(md5(cast(vec_id as varchar)),1,cast(4+vec_id%14 as int)),
                  '0123456789abcdef','ACDEFGHIKLMNPQRS') as s
      from embeddings) b
"""

SEQ_VECTORS = """
select seq, arg_min(embedding, id) as embedding
from designs d join embeddings e on e.vec_id = d.id
where regexp_full_match(seq, '[ARNDCEQGHILKMFPSTWYV]+')
group by seq
"""

PAIRS = """
select a.id as pair_id, a.seq as seqA, a.plddt as seqA_plddt, b.seq as seqB,
       b.plddt as seqB_plddt, a.label as target_id
from designs a join designs b on b.id = (a.id*7+3) % (select count(*) from embeddings)
"""

PAIR_SYSTEM = ("You compare two peptides. Put your reasons inside <think> </think>, then "
               "yes or no inside <answer> </answer>.")

PAIR_PROMPTS = """
select pair_id, '""" + PAIR_SYSTEM + """' as system_prompt,
  'Is '||seqA||' more likely to bind than '||seqB||'? Answer yes or no.' as user_prompt,
  case when pair_id%17=0 then seqA else seqA||'|'||seqB end as keywords,
  'pair_preference' as task, (seqA_plddt >= seqB_plddt)::INT as label, seqA_plddt, seqB_plddt
from pairs
"""

DOC_PROMPTS = """
select d.doc_id, 'Read the passage and answer yes or no.' as system_prompt,
  'Is this passage of good quality? '||text as user_prompt,
  lang||'|'||source as keywords, source as task,
  (case when toxic=1 then 2 else quality end)::INT as label,
  (n_chars % 1001) / 1000.0 as prob_score
from documents d left join labels l on l.doc_id = d.doc_id
"""

DESIGN_PROMPTS = """
select id as prompt_id, '""" + PAIR_SYSTEM + """' as system_prompt,
  'Design a cyclic peptide that binds better than '||seq||'.' as user_prompt,
  seq||'|'||substr(seq,1,3) as keywords, 'design' as task, seq as candidate,
  plddt as candidate_plddt
from designs
"""

DESIGN_CYCLES = """
select unnest(case when id%10=0 then [id%3, (id%3+1)%3] else [id%3] end) as cycle,
       seq as generate_seq, plddt
from designs
"""


def prompt_text(system: str, user: str) -> str:
    nl = "chr(10)"
    return ("'<|system|>' || " + nl + " || " + system + " || " + nl + " || '<|user|>' || " + nl
            + " || " + user + " || " + nl + " || '<|assistant|>' || " + nl)


def mlp_logit(x: str, hidden: int = 32) -> str:
    """Rule weights W1[j,i] = ((7i+13j)%11-5)/10, W2[j] = ((5j)%7-3)/10."""
    h = ("list_transform(range(" + str(hidden) + "), lambda j: greatest(list_sum("
         "list_transform(range(len(" + x + ")), lambda i: (((7*i+13*j)%11)-5)/10.0 * "
         + x + "[i+1])), 0.0))")
    return ("list_sum(list_transform(range(" + str(hidden) + "), lambda jj: (((5*jj)%7)-3)/10.0 * "
            + h + "[jj+1]))")


def vsub(a: str, b: str) -> str:
    return "list_transform(range(len(" + a + ")), lambda i: " + a + "[i+1] - " + b + "[i+1])"


def vround(v: str) -> str:
    return "list_transform(" + v + ", lambda x: round(x::DOUBLE, 6))"


def ctes(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(name + " AS (" + sql + ")" for name, sql in parts) + "\n"


DESIGN_COMPLETIONS = """
select g.id, case g.id%6
  when 3 then '<think>Short.</think><answer> '||g.seq||' </answer>'
  when 4 then '<think>Reasoning about '||r.seq||'</think> '||g.seq
  when 5 then '<think>Trying an empty design for '||r.seq||'.</think> <answer></answer>'
  else '<think>Design close to '||r.seq||' keeping '||substr(g.seq,1,3)||' motif.</think> <answer>'
       ||g.seq||'</answer>' end as completion,
  r.seq||'|'||substr(g.seq,1,3) as keywords, r.seq as candidate, r.plddt as candidate_plddt,
  g.id // 8 as step, g.id % 8 as pos
from designs g join designs r on r.id = (g.id*3+1) % (select count(*) from embeddings)
"""


def designed(c: str) -> tuple[str, str]:
    blk = "regexp_extract_all(" + c + ", '(?is)<answer>(.*?)</answer>', 1)"
    first = strip(blk + "[1]")
    valid = ("(case when len(" + blk + ") = 0 then null else regexp_full_match(" + first
             + ", '[" + RESIDUES + "]*') end)")
    return "(case when " + valid + " then " + first + " end)", valid


def composition(s: str) -> str:
    letters = ", ".join("'" + a + "'" for a in RESIDUES)
    return ("(case when length(" + s + ") > 0 then list_transform([" + letters + "], lambda a: "
            "((length(" + s + ") - length(replace(" + s + ", a, ''))) / length(" + s
            + "))::FLOAT) end)")


def motif_repeats(s: str, widths=(2, 3, 4)) -> str:
    parts = []
    for w in widths:
        m = ("list_transform(range(1, length(" + s + ") - " + str(w) + " + 2), lambda i: "
             "substring(" + s + ", i, " + str(w) + "))")
        cnt = "len(list_filter(" + m + ", lambda y: y = d))"
        parts.append("coalesce(list_sum(list_transform(list_distinct(" + m + "), lambda d: "
                     "case when " + cnt + " > 2 then " + cnt + " - 1 else 0 end)), 0)")
    return "(" + " + ".join(parts) + ")"


def sigmoid(x: str) -> str:
    return "(1.0 / (1.0 + exp(-(" + x + "))))"
