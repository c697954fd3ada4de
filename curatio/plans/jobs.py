"""End-to-end jobs composed from the operators: what a user of the reference runs.

* ``training_tables`` — load splits, attach parsed model outputs by position, subsample,
  carve a validation split, score and optionally substitute labels, build the model input
  and encode it (SURVEY §3.1).
* ``annotation_files`` — order page images, regroup detections and recognised strings per
  page, write Label.txt / rec_gt.txt / fileState.txt as ordered line folders (§3.2).
* ``dealt_folders`` — check the inputs, deal records out to annotator folders in near-equal
  blocks, write each folder's files and the copy manifest (§3.3).
* ``training_batches`` — encoded rows as padded batches, one per split, task and batch number.
* ``evaluation`` — predicted ids and label ids decoded and scored by the dataset's metric.
* ``materialise_source`` — a source's JSON array as prompts in permuted, ordered JSON-line splits.
* ``preprocess_documents`` — which documents lack page images or text, and what is made for them.

Each returns DataFrames (lazy) and writes only where asked; nothing passes through the
driver except one-row check results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatio.operators import align, metrics, pages, parse, positions, prompts, sampling, tokens
from curatio.session import passing_scratch
from curatio.sinks import files as sinks
from curatio.sinks.ledger import append_lines
from curatio.sources import files as sources
from curatio.spec import DatasetSpec, JobConfig, run_path_columns, spec_for

# --- fixed values: input schemas as the reference's loaders read them ---------------------
SCHEMAS = {
    "cqa": ("id string, question string, choices array<string>, answer string, "
            "abstractive_explanation string, extractive_explanation string"),
    "svamp": "input string, label string",
    "asdiv": "Body string, Question string, Formula string, Answer string",
    "esnli": ("premise string, hypothesis string, label int, explanation_1 string, explanation_2 string, "
              "explanation_3 string"),
    "anli1": "uid string, premise string, hypothesis string, label int, reason string",
}
REQUIRED = {        # columns without which a row is refused; the loaders drop the others
    "cqa": ["question", "choices", "answer"], "svamp": ["input", "label"], "asdiv": ["Body", "Question", "Answer"],
    "esnli": ["premise", "hypothesis", "label"], "anli1": ["premise", "hypothesis", "label"],
}
COT_GLOB = "{root}/{name}/llm/*_CoT_*.json"
SINGLE_GLOB = "{root}/gpt-neox/{name}/*.json"
# -------------------------------------------------------------------------------------------


@dataclass
class TrainingTables:
    encoded: DataFrame          # split, row_pos, encoded id arrays
    prepared: DataFrame         # split, row_pos, input, label (+ rationale, llm_label)
    label_accuracy: DataFrame | None   # per split, model label vs gold, before substitution
    run_paths: DataFrame        # one row: config_dir, output_dir, logging_dir


def _normalise(df: DataFrame, dataset: str) -> DataFrame:
    if dataset == "cqa":
        return prompts.cqa_prompt(df.drop("id", "abstractive_explanation", "extractive_explanation"))
    if dataset == "svamp":
        return df
    if dataset == "asdiv":
        d = df.select("split", "row_pos", F.col("Body").alias("body"), F.col("Question").alias("question"),
                      F.col("Answer").alias("answer"))
        return prompts.asdiv_prompt(d)
    if dataset == "esnli":
        return prompts.nli_label_names(df.drop("explanation_1", "explanation_2", "explanation_3"))
    if dataset == "anli1":
        return prompts.nli_label_names(df.drop("uid", "reason"))
    raise ValueError(f"unknown dataset {dataset!r}")


def _load(spark: SparkSession, root: str, spec: DatasetSpec) -> DataFrame:
    splits = ["train", "test"] + (["valid"] if spec.has_valid else [])
    df = sources.read_json_splits(spark, root, spec.name, SCHEMAS[spec.name], splits, REQUIRED[spec.name])
    df = _normalise(df, spec.name)
    train = positions.batch_subset(df.where(F.col("split") == "train"), spec.batch_size, spec.train_batch_idxs)
    return train.unionByName(df.where(F.col("split") != "train"))


def _outputs(spark: SparkSession, root: str, spec: DatasetSpec, model: str, on_bad: str) -> DataFrame:
    if model == "palm":
        raw = sources.read_output_arrays(spark, COT_GLOB.format(root=root, name=spec.name), sources.COT_SHARD_RE)
        listed = [("train", spec.train_batch_idxs), ("test", spec.test_batch_idxs),
                  ("valid", spec.valid_batch_idxs or ())]
        keep = None
        for split, idxs in listed:
            c = (F.col("split") == split) & F.col("shard").isin(list(idxs))
            keep = c if keep is None else keep | c
        raw = raw.where(keep)
    else:
        raw = sources.read_output_arrays(spark, SINGLE_GLOB.format(root=root, name=spec.name), sources.SINGLE_RE,
                                         has_shard=False)
    family = spec.family
    out = parse.parse_outputs(raw.select("split", "row_pos", "output"), family, model, on_bad=on_bad,
                              rationale_col="llm_rationale", label_col="llm_label")
    return out.drop("output")


def training_tables(spark: SparkSession, cfg: JobConfig, data_root: str, vocab: DataFrame | None = None,
                    vocab_size: int | None = None, subset: str = "full", on_bad: str = "fail",
                    out_path: str | None = None, out_root: str | None = None) -> TrainingTables:
    """Encoded tables of a run; written to ``out_path``, or to the run's own folders below ``out_root``."""
    cfg.validate()
    if cfg.dataset == "asdiv":   # SVAMP training set augmented with ASDiv; SVAMP test
        sv, ad = spec_for("svamp"), spec_for("asdiv")
        s_df, a_df = _load(spark, data_root, sv), _load(spark, data_root, ad)
        train = align.union_rebased([s_df.where("split = 'train'").drop("split"),
                                     a_df.where("split = 'train'").drop("split")], dense=True) \
            .drop("source_order").withColumn("split", F.lit("train"))
        df = train.unionByName(s_df.where("split = 'test'"))
        spec = sv
        if cfg.llm:
            so, ao = _outputs(spark, data_root, sv, cfg.llm, on_bad), _outputs(spark, data_root, ad, cfg.llm, on_bad)
            t_out = align.union_rebased([so.where("split = 'train'").drop("split"),
                                         ao.where("split = 'train'").drop("split")], dense=True) \
                .drop("source_order").withColumn("split", F.lit("train"))
            outs = t_out.unionByName(so.where("split = 'test'"))
    else:
        spec = spec_for(cfg.dataset, subset)
        df = _load(spark, data_root, spec)
        outs = _outputs(spark, data_root, spec, cfg.llm, on_bad) if cfg.llm else None

    if cfg.llm:
        df = align.attach_by_position(df, outs, ["split", "row_pos"])
    df = sampling.subsample_train(df, cfg.subsample, cfg.run)
    if not spec.has_valid:
        df = sampling.carve_valid(df, seed=0, valid_size=0.1)

    acc = None
    if cfg.label_type == "llm":
        if cfg.dataset in ("svamp", "asdiv"):
            acc = metrics.equation_accuracy(df, "llm_label", "label", group=["split"])
        else:
            acc = metrics.text_accuracy(df, "llm_label", "label", ["split"])
        df = prompts.label_substitution(df)
    if cfg.llm:
        if "rationale" in df.columns:
            df = df.drop("rationale")
        df = df.withColumnRenamed("llm_rationale", "rationale")
    if "nli" in cfg.dataset:
        df = prompts.nli_pair_input(df)

    keys = ["split", "row_pos"]
    if vocab is None:
        cols = ["input", "label"] + (["rationale"] if cfg.llm else [])
        vocab = tokens.build_vocab(df.where("split = 'train'"), cols, vocab_size, reserved=tokens.TASK_PREFIXES)
    li, lt = cfg.max_input_length, tokens.MAX_TARGET_LENGTH
    if cfg.model_type == "task_prefix":
        specs = [("input", "input_ids", li, "predict:"), ("input", "expl_input_ids", li, "explain:"),
                 ("label", "labels", lt, None), ("rationale", "aux_labels", lt, None)]
        masks = {"input_ids": "attention_mask", "expl_input_ids": "expl_attention_mask"}
    else:
        specs = [("input", "input_ids", li, None), ("label", "labels", lt, None)]
        masks = {"input_ids": "attention_mask"}
    enc = tokens.encode_many(df, keys, specs, vocab, masks=masks)
    enc = enc.select(*keys, *[s[1] for s in specs], *masks.values())
    run_paths = spark.range(1).select(*[c.alias(k) for k, c in run_path_columns(cfg).items()])
    if out_path:
        sinks.write_partitioned(enc, out_path, ["split"])
    if out_root:
        folders = run_paths.first()     # one row of configured names
        sinks.write_partitioned(enc, f"{out_root}/{folders.output_dir}/encoded", ["split"])
        if acc is not None:
            acc.write.mode("overwrite").json(f"{out_root}/{folders.logging_dir}/label_accuracy")
    return TrainingTables(enc, df, acc, run_paths)


def training_batches(encoded: DataFrame, batch_size: int, keys: Sequence[str] = ("split", "row_pos")) -> DataFrame:
    """Padded batches: (keys, task, batch, input_ids, attention_mask, labels).

    Rows of a split are numbered in order and cut into batches; two-task rows give a predict
    and an explain record of the same batch, each padded within its own task.  ``encoded`` is
    checkpointed, as both the numbers and the records come from it.
    """
    split, pos = keys
    enc = positions.materialize(encoded, "encoded")
    batch = F.floor(F.col("_idx") / F.lit(batch_size)).cast("bigint").alias("batch")
    numbers = positions.group_positions(enc.select(*keys), [split], [pos], "_idx").select(*keys, batch)
    if "expl_input_ids" in enc.columns:
        records = tokens.task_unpivot(enc, keys)
    else:
        records = enc.withColumn("task", F.lit("pred"))
    out = tokens.collate(records.join(numbers, list(keys)), [split, "batch", "task"])
    return out.select(*keys, "task", "batch", "input_ids", "attention_mask", "labels")


def evaluation(predictions: DataFrame, labels: DataFrame, dataset: str, model_type: str, vocab: DataFrame,
               keys: Sequence[str] = ("split", "row_pos"), group: Sequence[str] = ("split",)) -> DataFrame:
    """Accuracy per ``group`` of ``pred_ids`` against ``labels`` (id arrays, padded or not).

    Both sides are masked and decoded.  Arithmetic datasets compare the values of the
    equations, the others the texts.  A two-task model's tables hold a ``task`` column, and
    only the predict records count.  Rows without a partner stop the job.
    """
    spec_for(dataset)
    if model_type not in ("task_prefix", "standard"):
        raise ValueError(f"unknown model_type {model_type!r}")
    if model_type == "task_prefix":
        predictions, labels = predictions.where("task = 'pred'"), labels.where("task = 'pred'")
    both = align.attach_by_position(predictions.select(*keys, "pred_ids"), labels.select(*keys, "labels"), keys)
    both = both.select(*keys, tokens.mask_predictions("pred_ids").alias("pred_ids"), tokens.mask_labels("labels").alias("labels"))
    texts = tokens.decode_many(both, keys, {"pred_ids": "pred_text", "labels": "label_text"}, vocab)
    if dataset in ("svamp", "asdiv"):
        return metrics.equation_accuracy(texts, "pred_text", "label_text", list(group))
    return metrics.text_accuracy(texts, "pred_text", "label_text", list(group))


def materialise_source(spark: SparkSession, paths: str | Sequence[str], root: str, head: int = 800, seed: int = 0,
                       path_order_re: str | None = None) -> list[str]:
    """SVAMP's source array as ``{root}/svamp/svamp_{split}.json``: prompts in permuted order.

    The first ``head`` rows of the seeded permutation are the training split.
    """
    with passing_scratch(spark):        # the permutation is a checkpoint: the elements it was made from go
        rows = sources.read_json_array(spark, paths, "Body string, Question string, Equation string", path_order_re)
        rows = prompts.svamp_prompt(rows.select("row_pos", F.col("Body").alias("body"), F.col("Question").alias("question"),
                                                F.col("Equation").alias("equation")))
        splits = sampling.permute_head_split(rows, head, seed).select("split", "row_pos", "input", "label")
    return sinks.write_json_splits(splits, root, "svamp", spec_for("svamp").split_map, in_order=True)


def preprocess_documents(docs: DataFrame, images: DataFrame, done_texts: DataFrame, page_texts: DataFrame
                         ) -> dict[str, DataFrame]:
    """What is left to do per document, and its results.

    ``docs``: (doc, doc_order); ``images``: (path) of page images; ``done_texts``: (doc) with
    a text file; ``page_texts``: (doc, page, text).  Returns ``status`` (doc, has_images,
    has_text, todo), ``texts`` (doc, n_pages, text of the documents to do) and ``state``
    (lines of all images in order; none if nothing is to do, as then no file is written).
    """
    listed = images.select("path", pages.page_prefix("path").alias("doc"), pages.page_number("path").alias("page"))
    status = (docs.join(listed.select("doc").distinct().withColumn("_i", F.lit(True)), "doc", "left")
              .join(done_texts.select("doc").distinct().withColumn("_t", F.lit(True)), "doc", "left")
              .select("doc", F.coalesce("_i", F.lit(False)).alias("has_images"), F.coalesce("_t", F.lit(False)).alias("has_text"))
              .withColumn("todo", ~(F.col("has_images") & F.col("has_text"))))
    todo = status.where("todo").select("doc")
    ordered = pages.order_pages(listed.join(docs.select("doc", "doc_order"), "doc"))
    return {"status": status, "texts": pages.doc_text(page_texts.join(todo, "doc", "left_semi")),
            "state": pages.file_state_lines(ordered).where(~pages.all_done(todo))}


def annotation_files(spark: SparkSession, files: DataFrame, pdf_paths: Sequence[str], detections: DataFrame,
                     recognitions: DataFrame, out_root: str | None = None, folders: Sequence[str] | None = None,
                     batch_size: int = 4, test: bool = False, crop_folder: str = pages.CROP_FOLDER,
                     legacy_names: bool = False) -> dict[str, DataFrame]:
    """Label.txt, rec_gt.txt and fileState.txt lines for the listed page images.

    ``detections``: (path, poly_idx, points), the polygons of each image; ``recognitions``: (crop_pos, text) in flattened crop order of the processed pages.
    """
    listed = pages.order_pages(pages.list_pages(files, pdf_paths, folders))
    done = listed
    if test:
        listed = positions.test_subset(listed, batch_size)
    entries = pages.page_entries(listed, detections, recognitions)
    out = {"Label.txt": pages.label_lines(entries),
           "rec_gt.txt": pages.rec_gt_lines(entries, crop_folder, legacy_names, batch_size)
           .select(F.col("row_pos").alias("page_pos"), "poly_idx", "line"),
           "fileState.txt": pages.file_state_lines(done)}
    if out_root:
        sinks.write_lines(out["Label.txt"], f"{out_root}/Label.txt")
        sinks.write_lines(out["rec_gt.txt"], f"{out_root}/rec_gt.txt", order=("page_pos", "poly_idx"))
        sinks.write_lines(out["fileState.txt"], f"{out_root}/fileState.txt")
    return out


def append_annotations(entries: DataFrame, out_root: str, batch: int, crop_folder: str = pages.CROP_FOLDER,
                       legacy_names: bool = False, batch_size: int = 4) -> bool:
    """Label.txt and rec_gt.txt lines of a batch of page entries, appended once (see ``sinks.ledger``).

    Each of the two has its own ledger, so a run that stopped between them goes on with the second.
    False if both had the batch already.
    """
    texts = pages.rec_gt_lines(entries, crop_folder, legacy_names, batch_size).select(F.col("row_pos").alias("page_pos"), "poly_idx", "line")
    new = append_lines(pages.label_lines(entries), f"{out_root}/Label.txt", batch)
    return append_lines(texts, f"{out_root}/rec_gt.txt", batch, order=("page_pos", "poly_idx")) or new


def _lines(spark: SparkSession, path: str) -> DataFrame:
    df = positions.file_positions(spark.read.text(path), "row_pos")
    return df.select("row_pos", F.col("value").alias("line"))


def dealt_folders(spark: SparkSession, files: DataFrame, label_path: str, state_path: str,
                  prefixes: Sequence[str], folder_names: Sequence[str], out_root: str | None = None
                  ) -> dict[str, DataFrame]:
    """Deal label and state lines out to annotator folders; manifest of images to copy."""
    images = pages.order_pages(pages.list_split_images(files, prefixes))
    label, state = _lines(spark, label_path), _lines(spark, state_path)
    summary = pages.alignment_summary(images, label, state, len(folder_names))
    summary.collect()   # one row; stops here when the inputs do not line up
    # written three ways (two line files and the manifest) from its checkpoint
    dealt = pages.deal_out(label, state, folder_names)
    manifest = pages.copy_manifest(dealt, images)
    if out_root:
        sinks.write_lines(dealt.withColumnRenamed("label_line", "line"), f"{out_root}/Label.txt",
                          partition_by=["folder"])
        sinks.write_lines(dealt.withColumnRenamed("state_line", "line"), f"{out_root}/fileState.txt",
                          partition_by=["folder"])
        manifest.write.mode("overwrite").parquet(f"{out_root}/copy_manifest")
    return {"dealt": dealt, "manifest": manifest, "summary": summary}
