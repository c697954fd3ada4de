"""Registered queries: the end-to-end jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio.operators import pages, parse, tokens
from curatio.operators.positions import materialize
from curatio.plans import catalog_tokens as ct
from curatio.plans import fixtures as fx
from curatio.plans import jobs
from curatio.plans.catalog import register
from curatio.plans.catalog_pages import _rank_sql
from curatio.plans.fixture_sql import CTES, with_ctes
from curatio.session import passing_scratch, scratch_path
from curatio.sinks import files as sinks
from curatio.sources import files as sources

KEYS = ct.KEYS
NL = "chr(10)"


@register("job_evaluation", ct._nli_base([ct._B_LAB, ct._B_LLM, ("svamp_full", CTES["svamp_full"])]) +
          f"SELECT 'esnli' AS dataset, p.split, avg(cast(({ct._decoded_sql('b_llm.body')}) = "
          f"({ct._decoded_sql('b_lab.body')}) AS double)) AS accuracy, cast(count(*) AS bigint) AS n "
          "FROM prep p LEFT JOIN b_lab ON b_lab.split = p.split AND b_lab.row_pos = p.row_pos "
          "LEFT JOIN b_llm ON b_llm.split = p.split AND b_llm.row_pos = p.row_pos GROUP BY p.split "
          "UNION ALL SELECT 'svamp', split, avg(cast(coalesce(llm_value = gold_value, false) AS double)), "
          "cast(count(*) AS bigint) FROM svamp_full GROUP BY split")
def q_job_evaluation(spark, sf_dir):
    """Model labels scored as predictions: a text dataset, and an arithmetic one with two tasks."""
    prep = ct.nli_prep(spark, sf_dir)
    vocab = ct.nli_vocab(spark, sf_dir, prep)
    enc = materialize(tokens.encode(prep, KEYS, {"label": "labels", "llm_label": "pred_ids"}, vocab, 256)
                      .select(*KEYS, "labels", "pred_ids"), "encoded")
    text = jobs.evaluation(enc.select(*KEYS, F.concat("pred_ids", F.array(F.lit(-1))).alias("pred_ids")),
                           enc.select(*KEYS, F.concat("labels", F.array(F.lit(-100))).alias("labels")),
                           "esnli", "standard", vocab)

    s = parse.parse_outputs(fx.svamp_full(spark, sf_dir), "svamp", "palm", label_col="llm_label") \
        .select(*KEYS, "equation", "llm_label")
    words = tokens.build_vocab(s, ["equation", "llm_label"])
    enc = materialize(tokens.encode(s, KEYS, {"equation": "labels", "llm_label": "pred_ids"}, words, 256)
                      .select(*KEYS, "labels", "pred_ids"), "encoded")
    # the explain records repeat the labels as predictions, and must not count
    both = enc.withColumn("task", F.lit("pred")).unionByName(
        enc.withColumn("task", F.lit("expl")).withColumn("pred_ids", F.col("labels")))
    value = jobs.evaluation(both.select("task", *KEYS, "pred_ids"), both.select("task", *KEYS, "labels"),
                            "svamp", "task_prefix", words)
    cols = ["split", "accuracy", "n"]
    return text.select(F.lit("esnli").alias("dataset"), *cols).unionByName(value.select(F.lit("svamp").alias("dataset"), *cols))


_STANDARD_SQL = (f"SELECT p.split, p.row_pos, {ct.ids_sql('b_in.body', 1024)} AS input_ids, "
                 f"{ct.ids_sql('b_lab.body', 256)} AS labels "
                 "FROM prep p LEFT JOIN b_in ON b_in.split = p.split AND b_in.row_pos = p.row_pos "
                 "LEFT JOIN b_lab ON b_lab.split = p.split AND b_lab.row_pos = p.row_pos")
_ONE_TASK_SQL = ("SELECT split, row_pos, 'pred' AS task, input_ids, list_resize([]::int[], len(input_ids), 1) AS attention_mask, "
                 "labels FROM enc")


@register("job_training_batches", ct._nli_base([ct._B_IN, ct._B_LAB, ("enc", _STANDARD_SQL)]) +
          ct._COLLATE_SQL.replace(ct._UNPIVOT_SQL, _ONE_TASK_SQL))
def q_job_training_batches(spark, sf_dir):
    """Padded batches of the one-task encoding (``collate_batches`` holds the two-task one)."""
    b = jobs.training_batches(ct.encoded_nli(spark, sf_dir, "standard"), ct.TRAIN_BATCH)
    return ct._as_text(b, ["input_ids", "attention_mask", "labels"])


@register("job_materialise", with_ctes("svamp_full") +
          f"SELECT CASE WHEN rk < 800 THEN 'train' ELSE 'test' END AS split, "
          f"CASE WHEN rk < 800 THEN rk ELSE rk - 800 END AS row_pos, body || {NL} || question AS input, equation AS label "
          f"FROM ({_rank_sql('svamp_full', 0)}) r")
def q_job_materialise(spark, sf_dir):
    """The source array written, made into split files by the job, and read back."""
    source, root = scratch_path(spark, "source"), scratch_path(spark, "materialised")
    with passing_scratch(spark):
        s = fx.svamp_full(spark, sf_dir).select("row_pos", F.col("body").alias("Body"), F.col("question").alias("Question"),
                                                F.col("equation").alias("Equation"))
        sinks.write_json_arrays(s, source, ["Body", "Question", "Equation"], chunk_rows=5000, compression="gzip")
    jobs.materialise_source(spark, f"{source}/chunk=*/*.txt.gz", root, path_order_re=r"/chunk=([0-9]+)/")
    return sources.read_json_splits(spark, root, "svamp", "input string, label string").select("split", "row_pos", "input", "label")


def preprocess_inputs(spark, sf_dir) -> dict:
    """Documents of which two thirds have page images and half have their text."""
    number = F.substring("doc", 4, 20).cast("bigint")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc"), F.col("doc_id").alias("doc_order"))
    texts = fx.page_texts(spark, sf_dir)
    images = texts.where(number % 3 != 0).select(F.concat(F.lit("raw/"), pages.page_file_name("doc", "page")).alias("path"))
    return {"docs": docs, "images": images, "done_texts": docs.where(number % 2 == 0).select("doc"), "page_texts": texts}


@register("job_preprocess",
          f"SELECT 'doc' || doc_id AS doc, doc_id % 3 <> 0 AS has_images, doc_id % 2 = 0 AS has_text, "
          f"(doc_id % 3 = 0 OR doc_id % 2 <> 0) AS todo, "
          f"CASE WHEN doc_id % 3 = 0 OR doc_id % 2 <> 0 THEN cast(len(string_split(text, {NL})) AS bigint) END AS n_pages, "
          f"CASE WHEN doc_id % 3 = 0 OR doc_id % 2 <> 0 THEN replace(text, {NL}, '') END AS text FROM documents")
def q_job_preprocess(spark, sf_dir):
    """Every document's state, and the text of those that still need work."""
    out = jobs.preprocess_documents(**preprocess_inputs(spark, sf_dir))
    return out["status"].join(out["texts"], "doc", "left").select("doc", "has_images", "has_text", "todo", "n_pages", "text")


@register("job_preprocess_state", with_ctes("page_texts") +
          "SELECT cast(row_number() OVER (ORDER BY cast(substring(doc, 4) AS bigint), page) - 1 AS bigint) AS row_pos, "
          "'raw/' || doc || '_page_' || page || '.png' || chr(9) || '1' AS line FROM page_texts "
          "WHERE cast(substring(doc, 4) AS bigint) % 3 <> 0")
def q_job_preprocess_state(spark, sf_dir):
    """State lines of all page images, as work is left."""
    return jobs.preprocess_documents(**preprocess_inputs(spark, sf_dir))["state"].select("row_pos", "line")
