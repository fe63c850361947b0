"""DuckDB SQL for the operators that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str) -> str:
    return f"""(select {key}, list_filter(string_split_regex(
              translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'),
              lambda x: x <> '') as w from {table})"""


def _shingles(table: str, key: str) -> str:
    return f"""
    select distinct {key}, unnest(case when len(w) = 0 then []
             when len(w) < 5 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g
    from {_words(table, key)}"""


OP1 = f"""
with short as (select distinct len(w) as k from {_words('benchmark', 'item_id')} where len(w) between 1 and 4),
d as ({_shingles('documents', 'doc_id')}
      union select doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))
      from {_words('documents', 'doc_id')}, short where len(w) >= k),
q as ({_shingles('benchmark', 'item_id')}),
n as (select item_id, count(*) as n_item from q group by item_id),
c as (select doc_id, item_id, count(*) as n_shared from d join q using (g) group by doc_id, item_id)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment
from c join n using (item_id) where n_shared * 100 >= n_item * 75
"""

_REACH = """
ways as (select a, b from links union all select b, a from links),
reach(id, root) as (select id, id from ids union select ways.b, reach.root from reach join ways on ways.a = reach.id),
comp as (select id, min(root) as root from reach group by id)"""

OP6 = f"""
with recursive ids as (select distinct vec_id as id from embeddings),
u as (select vec_id, label, embedding::double[] as v from embeddings
      where label is not null and embedding is not null
        and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
        and len(list_filter(embedding, lambda c: c <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from u x join u y on x.label = y.label and x.vec_id < y.vec_id
          and len(x.v) = len(y.v)
          where list_inner_product(x.v, y.v)
                / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))) >= 0.98),{_REACH},
n as (select a, count(*) as n from ways group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, c.root as component_id, e.vec_id = c.root as kept
from embeddings e join comp c on c.id = e.vec_id left join n on n.a = e.vec_id
"""

OP8 = f"""
with recursive ids as (select distinct doc_id as id from documents),
s as ({_shingles('documents', 'doc_id')}),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id
      group by all),
links as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b
          where 100 * c >= 75 * (na.n + nb.n - c)),{_REACH}
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.root as component_id, d.doc_id = c.root as kept
from documents d join comp c on c.id = d.doc_id left join n on n.doc_id = d.doc_id
"""

ORACLE_SQL = {"op1_benchmark_decontamination": OP1, "op6_embedding_near_dup": OP6, "op8_near_duplicates": OP8}
