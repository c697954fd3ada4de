"""DuckDB twins of ``curatio.plans.fixtures`` (common table expressions for the oracle)."""

from __future__ import annotations

def _image_path_sql(k: str) -> str:
    return (f"concat('raw/chapter', if({k} % 2 = 0, '4', '12'), '_page_', "
            f"if({k} % 50 = 7, concat('x', {k}), cast({k} // 2 as varchar)), "
            f"['.PNG', '.jpg', '.tiff'][{k} % 3 + 1])")


CTES: dict[str, str] = {
    "cqa_src": """
select case when p_partkey % 5 = 4 then 'test' else 'train' end as split,
       p_partkey as row_pos, concat('Which type is ', p_name, '?') as question,
       p_type as c0, p_brand as c1, p_name as c2, cast(p_size as varchar) as c3,
       'none' as c4, p_type as answer
from part""",
    "cqa_llm": """
select case when p_partkey % 5 = 4 then 'test' else 'train' end as split,
  p_partkey as row_pos, case cast(p_partkey % 8 as int)
  when 0 then concat('It is ', p_name, '. So the answer is (a) ', p_type, '.', chr(10), chr(10), 'Q: next')
  when 1 then concat('  Because ', p_name, ' So the answer is (b) ', p_brand)
  when 2 then concat('no marker ', p_name)
  when 3 then 'x So the answer is (a) y So the answer is (b) z'
  when 4 then concat('r', chr(10), 'So the answer is desk.')
  when 5 then concat('r So the answer is (c) ', p_type, ' (d) ', p_brand)
  when 6 then 'Q: leading So the answer is (a) b'
  else 'r So the answer is (e)  ' end as output
from part""",
    "nli_src": """
select case d.doc_id % 10 when 8 then 'valid' when 9 then 'test' else 'train' end as split,
  d.doc_id as row_pos,
  substring(d.text, 1, cast(floor(length(d.text) / 2) as int)) as premise,
  substring(d.text, cast(floor(length(d.text) / 2) as int) + 1) as hypothesis,
  cast(l.quality + l.toxic as int) as label
from documents d join labels l on d.doc_id = l.doc_id""",
    "nli_llm": """
select case doc_id % 10 when 8 then 'valid' when 9 then 'test' else 'train' end as split,
  doc_id as row_pos, case cast(doc_id % 6 as int)
  when 0 then concat('R', doc_id, '.', chr(10), 'Answer: ', case quality when 1 then 'neutral' else 'entailment' end, chr(10), chr(10), 'Premise: next')
  when 1 then 'R Answer:neutral'
  when 2 then 'R only'
  when 3 then 'R Answer: '
  when 4 then '  R Answer: a Answer: b Premise'
  else concat('R So the answer is ', case quality when 1 then 'neutral' else 'entailment' end, '.', chr(10), 'Premise: q') end as output
from labels""",
    "svamp_full": """
select case when row_pos % 5 = 4 then 'test' else 'train' end as split, * from (
select cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as bigint) as row_pos,
  concat('Order ', l_orderkey, ' has ', cast(l_quantity as int), ' boxes of ', l_linenumber, '.') as body,
  'How many items?' as question,
  concat('( ', cast(l_quantity as int), ' * ', l_linenumber, ' )') as equation,
  cast(cast(l_quantity as int) * l_linenumber as double) as gold_value,
  case when l_linenumber = 1 then 'no marker'
       when l_linenumber = 2 then concat('r The answer is (', cast(l_quantity as int), ' / 0).')
       when l_linenumber = 3 then concat('r The answer is (', l_linenumber, ' * ', cast(l_quantity as int), ').', chr(10), 'Q: next')
       else concat('r The answer is (', cast(l_quantity as int), ' + ', l_linenumber, ').') end as output,
  case when l_linenumber <= 2 then null
       when l_linenumber = 3 then cast(l_linenumber * cast(l_quantity as int) as double)
       else cast(cast(l_quantity as int) + l_linenumber as double) end as llm_value
from lineitem) s""",
    "page_files": f"""
select distinct {_image_path_sql('o_orderkey')} as path from orders""",
    "detections": f"""
select {_image_path_sql('l.l_orderkey')} as path,
  cast(row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) - 1 as bigint) as poly_idx,
  cast(l.l_quantity as int) - 10 as x0, cast(l.l_linenumber * 7 as int) as y0,
  cast(l.l_quantity as int) + 20 as x1, cast(l.l_linenumber * 7 + 5 as int) as y1, p.p_name as text
from lineitem l join part p on l.l_partkey = p.p_partkey""",
    "run_configs": """
select n_nationkey as run, case when n_regionkey % 2 = 0 then 'cqa' else 'esnli' end as dataset,
  'google/t5-v1_1-base' as from_pretrained,
  case when n_nationkey % 2 = 0 then 'task_prefix' else 'standard' end as model_type,
  8 * (1 + n_regionkey) as batch_size, 1 + n_nationkey % 4 as grad_steps
from nation""",
    "losses": """
select event_id, cast(floor(event_id / 64) as bigint) as step, value as pred_loss, value / 2 as expl_loss
from events""",
    "asdiv_src": """
select case when o_orderkey % 5 = 4 then 'test' else 'train' end as split,
  o_orderkey as row_pos, concat('Customer ', o_custkey, ' placed an order.') as body,
  'Which priority?' as question, concat(o_orderkey % 90, ' (items)') as answer
from orders""",
    "page_texts": """
select 'doc' || doc_id as doc, cast(p as bigint) as page, t as text from (
  select doc_id, unnest(string_split(text, chr(10))) as t,
         unnest(generate_series(1, len(string_split(text, chr(10))))) as p
  from documents) s""",
}


def with_ctes(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH a AS (...), b AS (...)`` for the named fixtures, then extra (name, sql) pairs."""
    parts = [f"{n} AS ({CTES[n]}\n)" for n in names]
    parts += [f"{n} AS ({q}\n)" for n, q in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
