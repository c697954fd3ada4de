"""Registered queries: file sources and sinks, run paths, and the incremental stream.

Each query has Spark write data it derived from the driver's tables into the shared
checkpoint folder, then reads it back through the source under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.operators import pages, prompts
from curatio.operators.positions import group_positions, materialize, stored
from curatio.plans import catalog_pages as cp
from curatio.plans import fixtures as fx
from curatio.plans import jobs
from curatio.plans import sql_text as S
from curatio.plans.catalog import ORACLE, _cqa_input_sql, register
from curatio.plans.fixture_sql import with_ctes
from curatio.session import passing_scratch, scratch_path
from curatio.sinks import files as sinks
from curatio.sinks.ledger import read_appended, stage_lines
from curatio.sources import files as sources
from curatio.spec import JobConfig, run_path_columns, spec_for
from curatio.streaming.outputs import parsed_output_stream, positioned_outputs, run_available, shard_offset_stream

NL = "chr(10)"
CQA_SCHEMA = ("id string, question string, choices array<string>, answer string, "
              "abstractive_explanation string, extractive_explanation string")
SVAMP_SCHEMA = "Body string, Question string, Equation string"


def _rebased(fixture: str, cols: str) -> str:
    return (with_ctes(fixture) + f"SELECT split, cast(row_number() OVER (PARTITION BY split ORDER BY row_pos) - 1 "
            f"AS bigint) AS row_pos, {cols} FROM {fixture}")


@register("src_json_splits", with_ctes("cqa_src") +
          "SELECT split, cast(row_number() OVER (PARTITION BY split ORDER BY row_pos) - 1 AS bigint) AS row_pos, "
          f"cast(row_pos AS varchar) AS id, {_cqa_input_sql()} AS input, answer AS label FROM cqa_src")
def q_src_json_splits(spark, sf_dir):
    root = scratch_path(spark, "json-splits")
    src = fx.cqa_src(spark, sf_dir).select(
        "split", "row_pos", F.col("row_pos").cast("string").alias("id"), "question",
        F.array("c0", "c1", "c2", "c3", "c4").alias("choices"), "answer",
        F.lit(None).cast("string").alias("abstractive_explanation"),
        F.lit(None).cast("string").alias("extractive_explanation"))
    sinks.write_json_splits(src, root, "cqa", {"train": "train", "test": "test"}, drop=("row_pos",))
    back = sources.read_json_splits(spark, root, "cqa", CQA_SCHEMA, ["train", "test"])
    p = prompts.cqa_prompt(back.drop("abstractive_explanation", "extractive_explanation"))
    return p.select("split", "row_pos", "id", "input", "label")


@register("src_json_array", with_ctes("svamp_full") +
          f"SELECT row_pos, body || {NL} || question AS input, equation AS label FROM svamp_full")
def q_src_json_array(spark, sf_dir):
    root = scratch_path(spark, "json-array")
    s = fx.svamp_full(spark, sf_dir).select("row_pos", F.col("body").alias("Body"),
                                            F.col("question").alias("Question"),
                                            F.col("equation").alias("Equation"))
    sinks.write_json_arrays(s, root, ["Body", "Question", "Equation"], chunk_rows=5000)
    back = sources.read_json_array(spark, f"{root}/chunk=*/*.txt", SVAMP_SCHEMA, r"/chunk=([0-9]+)/")
    back = back.withColumnRenamed("row_pos", "_p")
    back = prompts.svamp_prompt(back.select("_p", F.col("Body").alias("body"), F.col("Question").alias("question"),
                                            F.col("Equation").alias("equation")))
    return back.select(F.col("_p").alias("row_pos"), "input", "label")


def _cqa_llm_dense(spark, sf_dir) -> DataFrame:
    return group_positions(fx.cqa_llm(spark, sf_dir), ["split"], ["row_pos"], "pos") \
        .drop("row_pos").withColumnRenamed("pos", "row_pos")


@register("src_llm_shards", _rebased("cqa_llm", "output"))
def q_src_llm_shards(spark, sf_dir):
    root = scratch_path(spark, "llm-shards")
    sinks.write_output_shards(_cqa_llm_dense(spark, sf_dir), root, spec_for("cqa").batch_size)
    back = sources.read_output_arrays(spark, f"{root}/split=*/shard=*/*.txt", sources.PART_SHARD_RE)
    return back.select("split", "row_pos", "output")


@register("src_llm_single", _rebased("nli_llm", "output"))
def q_src_llm_single(spark, sf_dir):
    root = scratch_path(spark, "llm-single")
    dense = group_positions(fx.nli_llm(spark, sf_dir), ["split"], ["row_pos"], "pos") \
        .drop("row_pos").withColumnRenamed("pos", "row_pos")
    # written split by split: checkpoint once
    sinks.write_output_single(materialize(dense, "dense"), f"{root}/gpt-neox/esnli", ["train", "valid", "test"], 5000)
    back = sources.read_output_arrays(spark, f"{root}/gpt-neox/esnli/*.json", sources.SINGLE_RE, has_shard=False)
    return back.select("split", "row_pos", "output")


@register("src_tsv_lines", with_ctes("page_files", extra=[cp.OCR_PAGES_CTE]) +
          "SELECT row_pos, path AS key, '1' AS rest FROM ocr_pages")
def q_src_tsv_lines(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    sinks.write_lines(pages.file_state_lines(cp.ocr_pages(spark, sf_dir)), path)
    return sources.read_tsv_lines(spark, path)


@register("sink_json_splits", with_ctes("nli_src") +
          "SELECT split, cast(row_number() OVER (PARTITION BY split ORDER BY row_pos) - 1 AS bigint) AS row_pos, "
          "premise, hypothesis, label FROM nli_src")
def q_sink_json_splits(spark, sf_dir):
    root = scratch_path(spark, "sink-json")
    spec = spec_for("esnli")
    # as loaded from the source: split names are the source's own
    to_source = F.create_map(*[F.lit(x) for kv in spec.split_map.items() for x in kv])
    src = fx.nli_src(spark, sf_dir).withColumn("split", F.element_at(to_source, F.col("split")))
    sinks.write_json_splits(src, root, spec.name, spec.split_map)
    return sources.read_json_splits(spark, root, spec.name,
                                    "premise string, hypothesis string, label int",
                                    ["train", "valid", "test"]).select("split", "row_pos", "premise",
                                                                       "hypothesis", "label")


@register("split_folder_lines", cp._SPLIT_BASE.rstrip() + ",\n" + f"{cp._DEALT_CTE[0]} AS ({cp._DEALT_CTE[1]})\n" +
          """SELECT folder, 'Label.txt' AS file, cast(row_number() OVER (PARTITION BY folder ORDER BY row_pos) - 1 AS bigint) AS line_pos,
  label_line AS line FROM dealt
UNION ALL SELECT folder, 'fileState.txt', cast(row_number() OVER (PARTITION BY folder ORDER BY row_pos) - 1 AS bigint),
  state_line FROM dealt""")
def q_split_folder_lines(spark, sf_dir):
    _, lab, st = cp.split_inputs(spark, sf_dir)
    dealt = pages.deal_out(lab, st, cp.FOLDERS)
    root = scratch_path(spark, "folders")
    sinks.write_lines(dealt.withColumnRenamed("label_line", "line"), f"{root}/Label.txt", partition_by=["folder"])
    sinks.write_lines(dealt.withColumnRenamed("state_line", "line"), f"{root}/fileState.txt",
                      partition_by=["folder"])
    out = None
    for name in ("Label.txt", "fileState.txt"):
        df = spark.read.text(f"{root}/{name}").withColumn("folder", F.regexp_extract(
            F.col("_metadata.file_path"), r"/folder=([^/]+)/", 1))
        df = sources.file_positions(df, "line_pos", group_cols=["folder"])
        df = df.select("folder", F.lit(name).alias("file"), "line_pos", F.col("value").alias("line"))
        out = df if out is None else out.unionByName(df)
    return out


_CFG = JobConfig(dataset="cqa")
_MODEL_SQL = "split_part(from_pretrained, '/', 2)"
_DIR_SQL = (f"dataset || '/' || {_MODEL_SQL} || '/' || model_type || '/' || '{_CFG.llm}' || '/' || "
            f"'{_CFG.subsample}' || '/' || '{_CFG.label_type}' || '/' || '{_CFG.alpha}' || '/' || "
            f"'{_CFG.max_input_length}' || '/' || cast(grad_steps * batch_size AS varchar) || '/' || "
            f"'{_CFG.optimizer_name}' || '/' || '{_CFG.lr}'")


@register("run_paths", with_ctes("run_configs") +
          f"SELECT run, {_DIR_SQL} AS config_dir, 'ckpts/' || {_DIR_SQL} || '/' || run AS output_dir, "
          f"'logs/' || {_DIR_SQL} || '/' || run AS logging_dir FROM run_configs")
def q_run_paths(spark, sf_dir):
    rc = fx.run_configs(spark, sf_dir)
    cols = run_path_columns(_CFG, {c: F.col(c) for c in
                                   ["dataset", "from_pretrained", "model_type", "batch_size", "grad_steps", "run"]})
    return rc.select("run", *[v.alias(k) for k, v in cols.items()])


_GPT = S.parse_select("cqa", "gpt")


@register("stream_parse_outputs", with_ctes("cqa_llm") +
          f"SELECT split, cast(row_number() OVER (PARTITION BY split ORDER BY row_pos) - 1 AS bigint) AS row_pos, "
          f"{_GPT[0]} AS rationale, {_GPT[1]} AS label FROM cqa_llm")
def q_stream_parse_outputs(spark, sf_dir):
    """Two incremental runs (train shards, then test shards) equal one batch parse."""
    src = scratch_path(spark, "stream-src")
    sink = scratch_path(spark, "stream-sink")
    ckpt = scratch_path(spark, "stream-ckpt")
    dense = _cqa_llm_dense(spark, sf_dir)
    size = spec_for("cqa").batch_size
    for split in ("train", "test"):
        sinks.write_output_shards(dense.where(F.col("split") == split), f"{src}/{split}", size)
        stream = parsed_output_stream(spark, f"{src}/*/split=*/shard=*/*.txt", "cqa", "gpt")
        run_available(stream, sink, ckpt)
    return sources.shard_positions(spark.read.parquet(sink)).select("split", "row_pos", "rationale", "label")


@register("stream_positions", with_ctes("cqa_llm") +
          f"SELECT split, cast(row_number() OVER (PARTITION BY split ORDER BY row_pos) - 1 AS bigint) AS row_pos, "
          f"{_GPT[0]} AS rationale, {_GPT[1]} AS label FROM cqa_llm")
def q_stream_positions(spark, sf_dir):
    """Shards that come out of order over three runs get the batch reader's positions in the stream."""
    src, rows, offsets, c1, c2 = (scratch_path(spark, f"shards-{n}") for n in ("src", "rows", "offsets", "c1", "c2"))
    dense = materialize(_cqa_llm_dense(spark, sf_dir), "dense")
    size = spec_for("cqa").batch_size // 4
    for part in (2, 0, 1):
        sinks.write_output_shards(dense.where(F.floor(F.col("row_pos") / size) % 3 == part), f"{src}/{part}", size)
        glob = f"{src}/*/split=*/shard=*/*.txt"
        run_available(parsed_output_stream(spark, glob, "cqa", "gpt"), rows, c1)
        run_available(shard_offset_stream(spark, glob), offsets, c2)
    return positioned_outputs(spark, rows, offsets).select("split", "row_pos", "rationale", "label")


_LABEL_SQL, _REC_SQL = ORACLE["label_lines"], ORACLE["rec_gt_lines"]


@register("append_annotations",
          f"SELECT 'Label.txt' AS file, cast(row_number() OVER (ORDER BY row_pos) - 1 AS bigint) AS line_pos, line FROM ({_LABEL_SQL}) "
          f"UNION ALL SELECT 'rec_gt.txt', cast(row_number() OVER (ORDER BY row_pos, poly_idx) - 1 AS bigint), line FROM ({_REC_SQL})")
def q_append_annotations(spark, sf_dir):
    """Annotation lines appended in four batches, one of them twice and one staged but never committed before."""
    root, made = scratch_path(spark, "appended"), scratch_path(spark, "entries")
    with passing_scratch(spark):        # what the entries are made from goes
        entries = stored(cp.ocr_entries(spark, sf_dir), "entries", made)
    n = entries.count()
    for batch in (0, 1, 1, 3, 2):
        part = entries.where(F.floor(F.col("row_pos") * 4 / F.lit(max(n, 1))) == batch)
        if batch == 3:      # a run that was killed before its commit
            stage_lines(pages.label_lines(part), f"{root}/Label.txt", batch)
        jobs.append_annotations(part, root, batch)
    return read_appended(spark, f"{root}/Label.txt").withColumn("file", F.lit("Label.txt")).unionByName(
        read_appended(spark, f"{root}/rec_gt.txt").withColumn("file", F.lit("rec_gt.txt"))).select("file", "line_pos", "line")


@register("quarantine_shards", with_ctes("cqa_llm", extra=[(
    "shards", "SELECT split, output, (row_number() OVER (PARTITION BY split ORDER BY row_pos) - 1) // 50 AS shard, "
    "(row_number() OVER (PARTITION BY split ORDER BY row_pos) - 1) % 50 AS i FROM cqa_llm")]) + """
SELECT DISTINCT split, cast(shard AS bigint) AS shard, cast(NULL AS bigint) AS place, 'cut off: the array does not end' AS reason
FROM shards WHERE shard % 3 = 0 UNION ALL
SELECT split, cast(shard AS bigint), cast(i AS bigint), 'not a string' FROM shards WHERE shard % 3 = 1 AND output LIKE '%7%'""")
def q_quarantine_shards(spark, sf_dir):
    """Shards of which a third is cut off and a third holds numbers: what the reader puts into quarantine."""
    root, bad = scratch_path(spark, "damaged"), scratch_path(spark, "quarantine")
    shard, place = F.expr("row_pos div 50").alias("shard"), F.col("row_pos") % 50
    values = (_cqa_llm_dense(spark, sf_dir).select("split", shard, place.alias("i"), "output")
              .withColumn("value", F.when((F.col("shard") % 3 == 1) & F.col("output").contains("7"), F.lit("7"))
                          .otherwise(F.expr("regexp_replace(to_json(array(output)), '(?s)^.(.*).$', '$1')"))))
    texts = values.groupBy("split", "shard").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("s")).select(
        "split", "shard", F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["value"]), ", "), F.lit("]")).alias("value"))
    cut = F.when(F.col("shard") % 3 == 0, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    texts.withColumn("value", cut).write.partitionBy("split", "shard").text(root)
    sources.read_output_arrays(spark, f"{root}/split=*/shard=*/*.txt", sources.PART_SHARD_RE, quarantine=bad)
    found = spark.read.parquet(bad)
    return found.select(F.regexp_extract("path", sources.PART_SHARD_RE, 1).alias("split"),
                        F.regexp_extract("path", sources.PART_SHARD_RE, 2).cast("bigint").alias("shard"), "place", "reason")
