"""Registered queries: vocabulary, encoding, collation, decoding and id-sequence scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.functions.text import WORD_SPLIT_RE
from curatio.operators import align, metrics, parse, prompts, tokens
from curatio.plans import fixtures as fx
from curatio.plans import jobs
from curatio.plans import sql_text as S
from curatio.plans.catalog import _NLI_NAME_SQL, register
from curatio.plans.fixture_sql import with_ctes

TRAIN_BATCH = 64
ALPHA = 0.5

# ---------------------------------------------------------------------------------------
# Spark inputs
# ---------------------------------------------------------------------------------------


def nli_prep(spark, sf_dir) -> DataFrame:
    """E-NLI style rows: pair input, gold label name, model label and rationale attached."""
    src = prompts.nli_pair_input(prompts.nli_label_names(fx.nli_src(spark, sf_dir)))
    outs = parse.parse_outputs(fx.nli_llm(spark, sf_dir), "esnli", "palm",
                               rationale_col="rationale", label_col="llm_label").drop("output")
    return align.attach_by_position(src, outs, ["split", "row_pos"])


def nli_vocab(spark, sf_dir, prep=None) -> DataFrame:
    prep = prep if prep is not None else nli_prep(spark, sf_dir)
    return tokens.build_vocab(prep, ["input", "label", "rationale", "llm_label"], reserved=tokens.TASK_PREFIXES)


def encoded_nli(spark, sf_dir, mode: str) -> DataFrame:
    prep = nli_prep(spark, sf_dir)
    vocab = nli_vocab(spark, sf_dir, prep)
    li, lt = tokens.MAX_INPUT_LENGTH, tokens.MAX_TARGET_LENGTH
    if mode == "task_prefix":
        specs = [("input", "input_ids", li, "predict:"), ("input", "expl_input_ids", li, "explain:"),
                 ("label", "labels", lt, None), ("rationale", "aux_labels", lt, None)]
        enc = tokens.encode_many(prep, KEYS, specs, vocab,
                                 masks={"input_ids": "attention_mask", "expl_input_ids": "expl_attention_mask"})
        return enc.select("split", "row_pos", "input_ids", "attention_mask", "expl_input_ids",
                          "expl_attention_mask", "labels", "aux_labels")
    specs = [("input", "input_ids", li, None), ("label", "labels", lt, None)]
    enc = tokens.encode_many(prep, KEYS, specs, vocab, masks={"input_ids": "attention_mask"})
    return enc.select("split", "row_pos", "input_ids", "attention_mask", "labels")


def _as_text(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, tokens.ids_text(c))
    return df


# ---------------------------------------------------------------------------------------
# SQL pieces
# ---------------------------------------------------------------------------------------

def toks_sql(x: str) -> str:
    t = x
    for s in tokens.SPECIALS:
        t = f"replace({t}, '{s}', ' {s} ')"
    return f"string_split_regex({S.st(t)}, {S.q(WORD_SPLIT_RE)})"


def vocab_sql(src: str, cols: list[str], reserved: tuple[str, ...] = ()) -> str:
    unions = " UNION ALL ".join([f"SELECT unnest({toks_sql(c)}) AS word, 1 AS n FROM {src}" for c in cols]
                                + [f"SELECT {S.q(w)}, 0" for w in reserved])
    first = "".join(f"word <> {S.q(w)}, " for w in reserved)     # false sorts before true
    return (f"SELECT word, cast(rk + 3 AS int) AS id, cnt FROM ("
            f"SELECT word, cnt, row_number() OVER (ORDER BY {first}cnt DESC, word ASC) - 1 AS rk FROM ("
            f"SELECT word, cast(sum(n) AS bigint) AS cnt FROM ({unions}) w "
            f"WHERE word <> '' AND word NOT IN ('<pad>', '</s>', '<unk>') GROUP BY word) c) r")


def body_sql(src: str, keys: list[str], col: str, max_len: int, vocab: str = "vocab") -> str:
    """(keys, body list) for one text column: token ids before truncation to max_len-1."""
    k = ", ".join(keys)
    tk = ", ".join(f"t.{x}" for x in keys)
    return (f"SELECT {tk}, list(coalesce(CASE t.word WHEN '<pad>' THEN 0 WHEN '</s>' THEN 1 WHEN '<unk>' THEN 2 END, "
            f"v.id, 2) ORDER BY t.pos) AS body FROM ("
            f"SELECT {k}, unnest(arr) AS word, unnest(generate_series(0, len(arr) - 1)) AS pos FROM ("
            f"SELECT {k}, {toks_sql(col)} AS arr FROM {src}) a) t LEFT JOIN {vocab} v ON v.word = t.word "
            f"WHERE t.word <> '' AND t.pos < {max_len - 1} GROUP BY {tk}")


def ids_sql(body: str, max_len: int, prefix_word: str | None = None, vocab: str = "vocab") -> str:
    b = f"coalesce({body}, []::int[])"
    if prefix_word:
        b = (f"list_concat([{['predict:', 'explain:'].index(prefix_word) + 3}], {b})"
             f"[1:{max_len - 1}]")
    return f"list_concat({b}, [1])"


def txt(lst: str) -> str:
    return f"array_to_string({lst}, ',')"


def mask_txt(lst: str) -> str:
    return f"array_to_string(list_resize([]::int[], len({lst}), 1), ',')"


_NLI_PARSE = S.parse_select("esnli", "palm")
NLI_PREP_SQL = (f"SELECT coalesce(s.split, l.split) AS split, coalesce(s.row_pos, l.row_pos) AS row_pos, "
                f"s.premise || '</s>' || s.hypothesis AS input, {_NLI_NAME_SQL.replace('label', 's.label')} AS label, "
                f"{_NLI_PARSE[1].replace('output', 'l.output')} AS llm_label, "
                f"{_NLI_PARSE[0].replace('output', 'l.output')} AS rationale "
                "FROM nli_src s FULL OUTER JOIN nli_llm l ON s.split = l.split AND s.row_pos = l.row_pos")
KEYS = ["split", "row_pos"]


def _nli_base(extra: list[tuple[str, str]]) -> str:
    return with_ctes("nli_src", "nli_llm", extra=[("prep", NLI_PREP_SQL),
                                                   ("vocab", vocab_sql("prep", ["input", "label", "rationale", "llm_label"],
                                                                      ("predict:", "explain:"))),
                                                   *extra])


_B_IN = ("b_in", body_sql("prep", KEYS, "input", 1024))
_B_LAB = ("b_lab", body_sql("prep", KEYS, "label", 256))
_B_RAT = ("b_rat", body_sql("prep", KEYS, "rationale", 256))
_JOIN = ("FROM prep p LEFT JOIN b_in ON b_in.split = p.split AND b_in.row_pos = p.row_pos "
         "LEFT JOIN b_lab ON b_lab.split = p.split AND b_lab.row_pos = p.row_pos "
         "LEFT JOIN b_rat ON b_rat.split = p.split AND b_rat.row_pos = p.row_pos")
_TP_COLS = {
    "input_ids": ids_sql("b_in.body", 1024, "predict:"),
    "expl_input_ids": ids_sql("b_in.body", 1024, "explain:"),
    "labels": ids_sql("b_lab.body", 256),
    "aux_labels": ids_sql("b_rat.body", 256),
}
ENC_TP_SQL = ("SELECT p.split, p.row_pos, " + ", ".join(f"{v} AS {k}" for k, v in _TP_COLS.items()) + " " + _JOIN)

# ---------------------------------------------------------------------------------------
# T01–T08, J06, A03, A04
# ---------------------------------------------------------------------------------------


@register("vocab_build", with_ctes(extra=[("vocab", vocab_sql("documents", ["text"]))]) +
          "SELECT word, id, cnt FROM vocab")
def q_vocab_build(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return tokens.build_vocab(docs, ["text"])


@register("encode_inputs", _nli_base([_B_IN]) +
          f"SELECT p.split, p.row_pos, {txt(ids_sql('b_in.body', 1024))} AS input_ids, "
          f"{mask_txt(ids_sql('b_in.body', 1024))} AS attention_mask "
          "FROM prep p LEFT JOIN b_in ON b_in.split = p.split AND b_in.row_pos = p.row_pos")
def q_encode_inputs(spark, sf_dir):
    prep = nli_prep(spark, sf_dir)
    enc = tokens.encode(prep, KEYS, {"input": "input_ids"}, nli_vocab(spark, sf_dir, prep), 1024,
                        masks={"input_ids": "attention_mask"})
    return _as_text(enc.select(*KEYS, "input_ids", "attention_mask"), ["input_ids", "attention_mask"])


@register("encode_targets", _nli_base([_B_LAB, _B_RAT]) +
          f"SELECT p.split, p.row_pos, {txt(ids_sql('b_lab.body', 256))} AS labels, "
          f"{txt(ids_sql('b_rat.body', 256))} AS aux_labels "
          "FROM prep p LEFT JOIN b_lab ON b_lab.split = p.split AND b_lab.row_pos = p.row_pos "
          "LEFT JOIN b_rat ON b_rat.split = p.split AND b_rat.row_pos = p.row_pos")
def q_encode_targets(spark, sf_dir):
    prep = nli_prep(spark, sf_dir)
    enc = tokens.encode(prep, KEYS, {"label": "labels", "rationale": "aux_labels"},
                        nli_vocab(spark, sf_dir, prep), 256)
    return _as_text(enc.select(*KEYS, "labels", "aux_labels"), ["labels", "aux_labels"])


_TP_TEXT_COLS = ["input_ids", "attention_mask", "expl_input_ids", "expl_attention_mask", "labels", "aux_labels"]


@register("encode_task_prefix", _nli_base([_B_IN, _B_LAB, _B_RAT]) +
          "SELECT p.split, p.row_pos, "
          f"{txt(_TP_COLS['input_ids'])} AS input_ids, {mask_txt(_TP_COLS['input_ids'])} AS attention_mask, "
          f"{txt(_TP_COLS['expl_input_ids'])} AS expl_input_ids, "
          f"{mask_txt(_TP_COLS['expl_input_ids'])} AS expl_attention_mask, "
          f"{txt(_TP_COLS['labels'])} AS labels, {txt(_TP_COLS['aux_labels'])} AS aux_labels " + _JOIN)
def q_encode_task_prefix(spark, sf_dir):
    return _as_text(encoded_nli(spark, sf_dir, "task_prefix"), _TP_TEXT_COLS)


@register("encode_standard", _nli_base([_B_IN, _B_LAB]) +
          f"SELECT p.split, p.row_pos, {txt(ids_sql('b_in.body', 1024))} AS input_ids, "
          f"{mask_txt(ids_sql('b_in.body', 1024))} AS attention_mask, {txt(ids_sql('b_lab.body', 256))} AS labels "
          "FROM prep p LEFT JOIN b_in ON b_in.split = p.split AND b_in.row_pos = p.row_pos "
          "LEFT JOIN b_lab ON b_lab.split = p.split AND b_lab.row_pos = p.row_pos")
def q_encode_standard(spark, sf_dir):
    return _as_text(encoded_nli(spark, sf_dir, "standard"), ["input_ids", "attention_mask", "labels"])


_UNPIVOT_SQL = ("SELECT split, row_pos, 'pred' AS task, input_ids, list_resize([]::int[], len(input_ids), 1) AS attention_mask, "
                "labels FROM enc UNION ALL SELECT split, row_pos, 'expl', expl_input_ids, "
                "list_resize([]::int[], len(expl_input_ids), 1), aux_labels FROM enc")


@register("task_unpivot", _nli_base([_B_IN, _B_LAB, _B_RAT, ("enc", ENC_TP_SQL)]) +
          "SELECT split, row_pos, task, array_to_string(input_ids, ',') AS input_ids, "
          "array_to_string(attention_mask, ',') AS attention_mask, array_to_string(labels, ',') AS labels "
          f"FROM ({_UNPIVOT_SQL}) u")
def q_task_unpivot(spark, sf_dir):
    u = tokens.task_unpivot(encoded_nli(spark, sf_dir, "task_prefix"), KEYS)
    return _as_text(u, ["input_ids", "attention_mask", "labels"])


_COLLATE_SQL = (
    "SELECT split, row_pos, task, batch, "
    "array_to_string(list_resize(input_ids, max(len(input_ids)) OVER w, 0), ',') AS input_ids, "
    "array_to_string(list_resize(attention_mask, max(len(input_ids)) OVER w, 0), ',') AS attention_mask, "
    "array_to_string(list_resize(labels, max(len(labels)) OVER w, -100), ',') AS labels FROM ("
    f"SELECT *, (dense_rank() OVER (PARTITION BY split ORDER BY row_pos) - 1) // {TRAIN_BATCH} AS batch "
    f"FROM ({_UNPIVOT_SQL}) u) b WINDOW w AS (PARTITION BY split, batch, task)")


def collated(spark, sf_dir) -> DataFrame:
    return jobs.training_batches(encoded_nli(spark, sf_dir, "task_prefix"), TRAIN_BATCH)


@register("collate_batches", _nli_base([_B_IN, _B_LAB, _B_RAT, ("enc", ENC_TP_SQL)]) + _COLLATE_SQL)
def q_collate_batches(spark, sf_dir):
    c = collated(spark, sf_dir)
    return _as_text(c.select(*KEYS, "task", "batch", "input_ids", "attention_mask", "labels"),
                    ["input_ids", "attention_mask", "labels"])


@register("mask_ids", _nli_base([_B_IN, _B_LAB, _B_RAT, ("enc", ENC_TP_SQL), ("col", _COLLATE_SQL)]) +
          "SELECT split, row_pos, task, regexp_replace(labels, '-100', '0', 'g') || ',0' AS pred_masked, "
          "regexp_replace(labels, '-100', '0', 'g') || ',-7' AS label_masked FROM col")
def q_mask_ids(spark, sf_dir):
    c = collated(spark, sf_dir).withColumn("labels", F.concat("labels", F.array(F.lit(-7))))   # only predictions lose it
    return c.select(*KEYS, "task", tokens.ids_text(tokens.mask_predictions("labels")).alias("pred_masked"),
                    tokens.ids_text(tokens.mask_labels("labels")).alias("label_masked"))


def _decoded_sql(body: str) -> str:
    """Text of the kept in-vocabulary words of a body list (what decode(encode(x)) gives)."""
    return (f"coalesce((SELECT string_agg(v.word, ' ' ORDER BY g.i) FROM (SELECT unnest({body}) AS id, "
            f"unnest(generate_series(1, len({body}))) AS i) g JOIN vocab v ON v.id = g.id), '')")


@register("decode_ids", _nli_base([_B_LAB]) +
          f"SELECT p.split, p.row_pos, {_decoded_sql('b_lab.body')} AS text "
          "FROM prep p LEFT JOIN b_lab ON b_lab.split = p.split AND b_lab.row_pos = p.row_pos")
def q_decode_ids(spark, sf_dir):
    prep = nli_prep(spark, sf_dir)
    vocab = nli_vocab(spark, sf_dir, prep)
    enc = tokens.encode(prep, KEYS, {"label": "labels"}, vocab, 256)
    return tokens.decode(enc, KEYS, "labels", vocab, "text", prepartitioned=True).select(*KEYS, "text")


_B_LLM = ("b_llm", body_sql("prep", KEYS, "llm_label", 256))


@register("decoded_text_accuracy", _nli_base([_B_LAB, _B_LLM]) +
          f"SELECT p.split, avg(cast(({_decoded_sql('b_llm.body')}) = ({_decoded_sql('b_lab.body')}) AS double)) "
          "AS accuracy, cast(count(*) AS bigint) AS n "
          "FROM prep p LEFT JOIN b_lab ON b_lab.split = p.split AND b_lab.row_pos = p.row_pos "
          "LEFT JOIN b_llm ON b_llm.split = p.split AND b_llm.row_pos = p.row_pos GROUP BY p.split")
def q_decoded_text_accuracy(spark, sf_dir):
    prep = nli_prep(spark, sf_dir)
    vocab = nli_vocab(spark, sf_dir, prep)
    enc = tokens.encode(prep, KEYS, {"label": "labels", "llm_label": "pred_ids"}, vocab, 256)
    enc = enc.select(*KEYS, tokens.mask_predictions("pred_ids").alias("pred_ids"),
                     tokens.mask_labels("labels").alias("labels"))
    d = tokens.decode_many(enc, KEYS, {"pred_ids": "pred_text", "labels": "label_text"}, vocab,
                           prepartitioned=True)
    return metrics.text_accuracy(d, "pred_text", "label_text", ["split"])


@register("decoded_eq_accuracy", with_ctes("svamp_full") +
          "SELECT avg(cast(coalesce(llm_value = gold_value, false) AS double)) AS accuracy, "
          "cast(count(*) AS bigint) AS n FROM svamp_full")
def q_decoded_eq_accuracy(spark, sf_dir):
    s = parse.parse_outputs(fx.svamp_full(spark, sf_dir), "svamp", "palm", label_col="llm_label")
    s = s.select("row_pos", "equation", "llm_label")
    vocab = tokens.build_vocab(s, ["equation", "llm_label"])
    enc = tokens.encode(s, ["row_pos"], {"equation": "labels", "llm_label": "pred_ids"}, vocab, 256)
    enc = enc.select("row_pos", tokens.mask_predictions("pred_ids").alias("pred_ids"),
                     tokens.mask_labels("labels").alias("labels"))
    d = tokens.decode_many(enc, ["row_pos"], {"pred_ids": "pred_text", "labels": "label_text"}, vocab,
                           prepartitioned=True)
    return metrics.equation_accuracy(d, "pred_text", "label_text", group=())


@register("loss_blend", with_ctes("losses") +
          f"SELECT step, round(avg({ALPHA} * pred_loss + {1 - ALPHA} * coalesce(expl_loss, pred_loss)), 10) AS loss, "
          "cast(count(*) AS bigint) AS n FROM losses GROUP BY step")
def q_loss_blend(spark, sf_dir):
    b = tokens.blend_losses(fx.losses(spark, sf_dir), ALPHA, output_rationale=True)
    return b.withColumn("loss", F.round("loss", 10))
