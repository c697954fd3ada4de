"""Registered queries: positions, sampling, concatenation and the page pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.operators import align, pages, positions, prompts, sampling
from curatio.plans import fixtures as fx
from curatio.plans.catalog import ATTACH_SQL, attach_cqa, register
from curatio.plans.fixture_sql import CTES, with_ctes

NL = "chr(10)"
PDFS = ["data/chapter4.pdf", "data/chapter12.pdf"]
IMG_W = IMG_H = 40
SPLIT_PREFIXES = ("chapter4_", "chapter12_")
FOLDERS = ("annotator_1", "annotator_2", "annotator_3", "annotator_4")
_FOLDER_SQL = "['annotator_1', 'annotator_2', 'annotator_3', 'annotator_4']"
PAGE_BATCH = 4

# ---------------------------------------------------------------------------------------
# W01–W03, F01, F03: positions, blocks, batches
# ---------------------------------------------------------------------------------------


_LI_KEY_SQL = ", ".join(fx.LINEITEM_KEY)


@register("row_positions",
          f"SELECT cast(row_number() OVER (ORDER BY {_LI_KEY_SQL}) - 1 AS bigint) AS row_pos, {_LI_KEY_SQL} "
          "FROM lineitem")
def q_row_positions(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*fx.LINEITEM_KEY)
    return positions.dense_positions(li, fx.LINEITEM_KEY, "row_pos")


# SQL pieces for the page listing
_BASE = "regexp_extract(path, '[^/]*$', 0)"
_DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
_PAGE = (f"try_cast(nullif(regexp_extract({_BASE}, '(?i)^.*page_([0-9]+)\\.(png|jpg|jpeg)$', 1), '') "
         "as bigint)")
_EXT_CI = " or ".join(f"ends_with(lower({_BASE}), '.{e}')" for e in pages.PAGE_EXTS)
_EXT_CS = " or ".join(f"ends_with({_BASE}, '.{e}')" for e in pages.SPLIT_GLOB_EXTS)

_LISTING_SQL = " UNION ALL ".join(
    f"SELECT {i} AS doc_order, '{d}' AS doc, path, {_PAGE} AS page FROM page_files "
    f"WHERE {_DIR} = 'raw' AND ({_EXT_CI}) AND starts_with({_BASE}, '{d}_page_')"
    for i, d in enumerate(["chapter4", "chapter12"]))
_SPLIT_LISTING_SQL = " UNION ALL ".join(
    f"SELECT {i} AS doc_order, '{pre}' AS doc, path, {_PAGE} AS page FROM page_files "
    f"WHERE {_DIR} = 'raw' AND ({_EXT_CS}) AND starts_with({_BASE}, '{pre}') "
    f"AND NOT starts_with({_BASE}, '.')"
    for i, pre in enumerate(SPLIT_PREFIXES))
_ORDERED = ("SELECT cast(row_number() OVER (ORDER BY doc_order, page NULLS LAST, path) - 1 AS bigint) AS row_pos, "
            "doc_order, doc, path, page FROM ({0}) l")
OCR_PAGES_CTE = ("ocr_pages", _ORDERED.format(_LISTING_SQL))
SPLIT_IMAGES_CTE = ("split_images", _ORDERED.format(_SPLIT_LISTING_SQL))


def page_files(spark, sf_dir) -> DataFrame:
    return fx.page_files(spark, sf_dir)


def ocr_pages(spark, sf_dir) -> DataFrame:
    return pages.order_pages(pages.list_pages(page_files(spark, sf_dir), PDFS))


def split_images(spark, sf_dir) -> DataFrame:
    return pages.order_pages(pages.list_split_images(page_files(spark, sf_dir), SPLIT_PREFIXES))


@register("page_listing", with_ctes("page_files") +
          f"SELECT doc_order, doc, path, page, "
          f"CASE WHEN regexp_matches({_BASE}, '^(.*[^.].*)\\.[^.]*$') "
          f"THEN regexp_extract({_BASE}, '^(.*[^.].*)\\.[^.]*$', 1) ELSE {_BASE} END AS stem "
          f"FROM ({_LISTING_SQL}) l")
def q_page_listing(spark, sf_dir):
    return pages.list_pages(page_files(spark, sf_dir), PDFS).withColumn("stem", pages.doc_name("path"))


@register("page_order", with_ctes("page_files", extra=[OCR_PAGES_CTE]) +
          "SELECT row_pos, doc, path, page FROM ocr_pages")
def q_page_order(spark, sf_dir):
    return ocr_pages(spark, sf_dir).select("row_pos", "doc", "path", "page")


@register("page_prefix", with_ctes("page_files") +
          f"SELECT path, coalesce(nullif(regexp_extract({_BASE}, "
          f"'(?i)^([a-zA-Z0-9]+)_page_[0-9]+\\.(png|jpg|jpeg)$', 1), ''), 'unknownprefix') AS prefix "
          "FROM page_files")
def q_page_prefix(spark, sf_dir):
    return page_files(spark, sf_dir).select("path", pages.page_prefix("path").alias("prefix"))


@register("page_names", with_ctes("page_texts") +
          "SELECT doc, page, doc || '_page_' || page || '.png' AS page_name FROM page_texts")
def q_page_names(spark, sf_dir):
    t = fx.page_texts(spark, sf_dir)
    return t.select("doc", "page", pages.page_file_name("doc", "page").alias("page_name"))


@register("batch_numbers", with_ctes("page_files", extra=[OCR_PAGES_CTE]) +
          f"SELECT row_pos, path, row_pos // {PAGE_BATCH} AS batch, row_pos % {PAGE_BATCH} AS batch_idx "
          "FROM ocr_pages")
def q_batch_numbers(spark, sf_dir):
    return positions.batch_numbers(ocr_pages(spark, sf_dir), PAGE_BATCH).select(
        "row_pos", "path", "batch", "batch_idx")


@register("test_subset", with_ctes("page_files", extra=[OCR_PAGES_CTE]) +
          f"SELECT row_pos, path FROM ocr_pages WHERE row_pos < ceil(8 / {PAGE_BATCH}) * {PAGE_BATCH}")
def q_test_subset(spark, sf_dir):
    return positions.test_subset(ocr_pages(spark, sf_dir), PAGE_BATCH).select("row_pos", "path")


@register("equal_blocks", with_ctes("page_files", extra=[SPLIT_IMAGES_CTE]) +
          "SELECT row_pos, path, row_pos * 4 // (SELECT count(*) FROM split_images) AS block, "
          f"{_FOLDER_SQL}[row_pos * 4 // (SELECT count(*) FROM split_images) + 1] AS folder "
          "FROM split_images")
def q_equal_blocks(spark, sf_dir):
    b = positions.equal_blocks(split_images(spark, sf_dir), len(FOLDERS), "row_pos", "block")
    names = F.array(*[F.lit(f) for f in FOLDERS])
    return b.select("row_pos", "path", "block", F.get(names, F.col("block").cast("int")).alias("folder"))


# SVAMP training cap: batches of 500, indices 0 and 1 (1,000 rows)
@register("batch_subset", with_ctes("svamp_full") +
          f"SELECT row_pos, body || {NL} || question AS input, equation AS label FROM svamp_full "
          "WHERE floor(row_pos / 500) IN (0, 1)")
def q_batch_subset(spark, sf_dir):
    s = prompts.svamp_prompt(fx.svamp_full(spark, sf_dir).select("row_pos", "body", "question", "equation"))
    return positions.batch_subset(s, 500, range(2))


# ---------------------------------------------------------------------------------------
# R01–R03 sampling, U01–U03 concatenation
# ---------------------------------------------------------------------------------------

def _rank_sql(src: str, seed: int) -> str:
    return (f"SELECT *, row_number() OVER (ORDER BY md5(concat('{seed}', ':', cast(row_pos AS varchar))), "
            f"row_pos) - 1 AS rk, count(*) OVER () AS n FROM {src}")


@register("subsample_train",
          f"WITH a AS ({ATTACH_SQL}), t AS (SELECT * FROM a WHERE split = 'train'), "
          f"r AS ({_rank_sql('t', 0)}) "
          "SELECT split, row_pos, label, llm_label FROM r WHERE rk >= ceil(cast(0.5 AS double) * n)")
def q_subsample_train(spark, sf_dir):
    a = attach_cqa(spark, sf_dir).where(F.col("split") == "train")
    return sampling.subsample(a, 0.5, seed=0).select("split", "row_pos", "label", "llm_label")


@register("subsample_in_splits",
          f"WITH a AS ({ATTACH_SQL}), t AS (SELECT * FROM a WHERE split = 'train'), r AS ({_rank_sql('t', 3)}) "
          "SELECT split, row_pos, label, llm_label FROM r WHERE rk >= ceil(cast(0.75 AS double) * n) "
          "UNION ALL SELECT split, row_pos, label, llm_label FROM a WHERE split <> 'train'")
def q_subsample_in_splits(spark, sf_dir):
    """A quarter of the training split, the other splits whole."""
    a = attach_cqa(spark, sf_dir).select("split", "row_pos", "label", "llm_label")
    return sampling.subsample_train(a, 0.25, seed=3)


@register("train_valid_split",
          f"WITH a AS ({ATTACH_SQL}), t AS (SELECT * FROM a WHERE split = 'train'), "
          f"r AS ({_rank_sql('t', 0)}) "
          "SELECT CASE WHEN rk < ceil(cast(0.1 AS double) * n) THEN 'valid' ELSE 'train' END AS split, "
          "row_pos, label, llm_label FROM r "
          "UNION ALL SELECT split, row_pos, label, llm_label FROM a WHERE split <> 'train'")
def q_train_valid_split(spark, sf_dir):
    a = attach_cqa(spark, sf_dir).select("split", "row_pos", "label", "llm_label")
    return sampling.carve_valid(a, seed=0, valid_size=0.1)


@register("permute_head_split", with_ctes("svamp_full") +
          f"SELECT CASE WHEN rk < 800 THEN rk ELSE rk - 800 END AS row_pos, row_pos AS source_pos, "
          f"CASE WHEN rk < 800 THEN 'train' ELSE 'test' END AS split FROM ({_rank_sql('svamp_full', 0)}) r")
def q_permute_head_split(spark, sf_dir):
    s = fx.svamp_full(spark, sf_dir).select("row_pos", F.col("row_pos").alias("source_pos"))
    return sampling.permute_head_split(s, 800, seed=0)


@register("union_train", with_ctes("svamp_full", "asdiv_src") +
          f"""SELECT 0 AS source_order, cast(rp AS bigint) AS row_pos, input, label FROM (
  SELECT row_number() OVER (ORDER BY row_pos) - 1 AS rp, body || {NL} || question AS input, equation AS label
  FROM svamp_full WHERE split = 'train') a
UNION ALL
SELECT 1, cast(rp + (SELECT count(*) FROM svamp_full WHERE split = 'train') AS bigint), input, label FROM (
  SELECT row_number() OVER (ORDER BY row_pos) - 1 AS rp, body || {NL} || question AS input,
         split_part(answer, ' ', 1) AS label
  FROM asdiv_src WHERE split = 'train') b""")
def q_union_train(spark, sf_dir):
    sv = prompts.svamp_prompt(fx.svamp_full(spark, sf_dir).where(F.col("split") == "train")
                              .select("row_pos", "body", "question", "equation"))
    ad = prompts.asdiv_prompt(fx.asdiv_src(spark, sf_dir).where(F.col("split") == "train")
                              .select("row_pos", "body", "question", "answer"))
    return align.union_rebased([sv, ad], "row_pos").select("source_order", "row_pos", "input", "label")


# ---------------------------------------------------------------------------------------
# page pipeline: boxes, entries, lines
# ---------------------------------------------------------------------------------------

def detections_with_points(spark, sf_dir) -> DataFrame:
    d = fx.detections(spark, sf_dir)
    pts = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    return d.select("path", "poly_idx", pts.alias("points"), "text")


def recognitions_for(pgs: DataFrame, dets: DataFrame) -> DataFrame:
    """Recognised strings in flattened crop order, as a recogniser would return them."""
    j = dets.select("path", "poly_idx", "text").hint("merge").join(pgs.select("row_pos", "path"), "path").select("row_pos", "poly_idx", "text")
    return positions.dense_positions(j, ["row_pos", "poly_idx"], "crop_pos", keep=["text"]).select("crop_pos", "text")


def ocr_entries(spark, sf_dir) -> DataFrame:
    pgs = ocr_pages(spark, sf_dir)
    # a detector's output and, made from it here, a recogniser's: built once
    dets = positions.stored(detections_with_points(spark, sf_dir), "detections")
    return pages.page_entries(pgs, dets.drop("text"), recognitions_for(pgs, dets))


_DET_CTE = ("dets", CTES["detections"])
_ENTRY_JSON = ("'{\"transcription\": ' || cast(to_json(d.text) AS varchar) || ', \"points\": [[' || d.x0 || ', ' "
               "|| d.y0 || '], [' || d.x1 || ', ' || d.y0 || '], [' || d.x1 || ', ' || d.y1 || '], [' || d.x0 "
               "|| ', ' || d.y1 || ']], \"difficult\": false}'")
_ENTRIES_SQL = (f"SELECT p.row_pos, p.path, p.page, cast(count(d.poly_idx) AS bigint) AS n_entries, "
                f"'[' || coalesce(string_agg({_ENTRY_JSON}, ', ' ORDER BY d.poly_idx), '') || ']' AS entries_json "
                "FROM @PAGES p LEFT JOIN dets d ON d.path = p.path GROUP BY p.row_pos, p.path, p.page")
OCR_ENTRIES_CTE = ("ocr_entries", _ENTRIES_SQL.replace("@PAGES", "ocr_pages"))


@register("poly_bbox", with_ctes("detections") +
          f"SELECT path, poly_idx, greatest(least(x0, x1), 0) AS min_x, greatest(least(y0, y1), 0) AS min_y, "
          f"least(greatest(x0, x1), {IMG_W}) AS max_x, least(greatest(y0, y1), {IMG_H}) AS max_y FROM detections")
def q_poly_bbox(spark, sf_dir):
    d = detections_with_points(spark, sf_dir)
    x0, y0, x1, y1 = pages.polygon_bbox("points", IMG_W, IMG_H)
    return d.select("path", "poly_idx", x0.alias("min_x"), y0.alias("min_y"),
                    x1.alias("max_x"), y1.alias("max_y"))


@register("crops_per_page", with_ctes("detections") +
          "SELECT path, cast(count(*) AS bigint) AS n_crops FROM detections GROUP BY path")
def q_crops_per_page(spark, sf_dir):
    d = fx.detections(spark, sf_dir)
    return d.groupBy("path").agg(F.count(F.lit(1)).cast("bigint").alias("n_crops"))


@register("crop_offsets", with_ctes("page_files", "detections", extra=[OCR_PAGES_CTE]) +
          """SELECT row_pos, path, n_crops, cast(coalesce(sum(n_crops) OVER (ORDER BY row_pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS crop_offset FROM (
  SELECT p.row_pos, p.path, cast(count(d.path) AS bigint) AS n_crops FROM ocr_pages p
  LEFT JOIN detections d ON d.path = p.path GROUP BY p.row_pos, p.path) c""")
def q_crop_offsets(spark, sf_dir):
    pgs = ocr_pages(spark, sf_dir)
    counts = fx.detections(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("n_crops"))
    pc = (pgs.join(counts, "path", "left")
          .select("row_pos", "path", F.coalesce("n_crops", F.lit(0)).cast("bigint").alias("n_crops")))
    return positions.running_offsets(pc, ["row_pos"], "n_crops", "crop_offset")


@register("page_entries", with_ctes("page_files", extra=[OCR_PAGES_CTE, _DET_CTE, OCR_ENTRIES_CTE]) +
          "SELECT row_pos, path, n_entries, entries_json FROM ocr_entries")
def q_page_entries(spark, sf_dir):
    e = ocr_entries(spark, sf_dir)
    return e.select("row_pos", "path", "n_entries", pages.entries_json("entries").alias("entries_json"))


@register("label_lines", with_ctes("page_files", extra=[OCR_PAGES_CTE, _DET_CTE, OCR_ENTRIES_CTE]) +
          "SELECT row_pos, path || chr(9) || entries_json AS line FROM ocr_entries")
def q_label_lines(spark, sf_dir):
    return pages.label_lines(ocr_entries(spark, sf_dir))


@register("crop_table", with_ctes("page_files", extra=[OCR_PAGES_CTE, _DET_CTE]) +
          f"""SELECT p.row_pos, cast(row_number() OVER (ORDER BY p.row_pos, d.poly_idx) - 1 AS bigint) AS crop_pos, p.path, d.poly_idx,
  'crop_img/' || coalesce(nullif(regexp_extract({_BASE.replace('path', 'p.path')},
  '(?i)^([a-zA-Z0-9]+)_page_[0-9]+\\.(png|jpg|jpeg)$', 1), ''), 'unknownprefix')
  || '_page_' || coalesce(p.page, p.row_pos + 1) || '_crop_' || d.poly_idx || '.jpg' AS crop,
  greatest(least(x0, x1), 0) AS min_x, greatest(least(y0, y1), 0) AS min_y,
  least(greatest(x0, x1), {IMG_W}) AS max_x, least(greatest(y0, y1), {IMG_H}) AS max_y
FROM ocr_pages p JOIN dets d ON d.path = p.path""")
def q_crop_table(spark, sf_dir):
    return pages.crop_table(ocr_pages(spark, sf_dir), detections_with_points(spark, sf_dir).drop("text"), IMG_W, IMG_H)


@register("file_state_lines", with_ctes("page_files", extra=[OCR_PAGES_CTE]) +
          "SELECT row_pos, path || chr(9) || '1' AS line FROM ocr_pages")
def q_file_state_lines(spark, sf_dir):
    return pages.file_state_lines(ocr_pages(spark, sf_dir))


@register("rec_gt_lines", with_ctes("page_files", extra=[OCR_PAGES_CTE, _DET_CTE]) +
          f"""SELECT p.row_pos, d.poly_idx,
  'crop_img/' || coalesce(nullif(regexp_extract({_BASE.replace('path', 'p.path')},
  '(?i)^([a-zA-Z0-9]+)_page_[0-9]+\\.(png|jpg|jpeg)$', 1), ''), 'unknownprefix')
  || '_page_' || coalesce(p.page, p.row_pos + 1) || '_crop_' || d.poly_idx || '.jpg' || chr(9) || d.text AS line
FROM ocr_pages p JOIN dets d ON d.path = p.path""")
def q_rec_gt_lines(spark, sf_dir):
    return pages.rec_gt_lines(ocr_entries(spark, sf_dir))


@register("doc_text_concat",
          "SELECT 'doc' || doc_id AS doc, cast(len(string_split(text, chr(10))) AS bigint) AS n_pages, "
          "replace(text, chr(10), '') AS text FROM documents")
def q_doc_text_concat(spark, sf_dir):
    return pages.doc_text(fx.page_texts(spark, sf_dir))


# --- dealing out: split inputs are the split listing plus its label and state lines ------

def split_inputs(spark, sf_dir):
    """Images of the split listing with the Label.txt and fileState.txt lines written for them.

    The label file is an input of the split stage; it is built here by grouping detections
    per image directly (the page_entries query checks the offset-based regroup).
    """
    imgs = split_images(spark, sf_dir)
    dets = detections_with_points(spark, sf_dir)
    grouped = (dets.groupBy("path")
               .agg(F.sort_array(F.collect_list(F.struct("poly_idx", F.col("text").alias("transcription"),
                                                         "points"))).alias("_e")))
    e = (imgs.select("row_pos", "path").join(grouped, "path", "left")
         .withColumn("entries", F.transform(F.coalesce("_e", F.array().cast(grouped.schema["_e"].dataType)),
                                            lambda x: F.struct(x["transcription"].alias("transcription"),
                                                               x["points"].alias("points"),
                                                               F.lit(False).alias("difficult")))))
    return imgs, pages.label_lines(e), pages.file_state_lines(imgs)


_SPLIT_ENTRIES_CTE = ("split_entries", _ENTRIES_SQL.replace("@PAGES", "split_images"))
_SPLIT_BASE = with_ctes("page_files", extra=[SPLIT_IMAGES_CTE, _DET_CTE, _SPLIT_ENTRIES_CTE,
                                             ("lab", "SELECT row_pos, path || chr(9) || entries_json AS line "
                                                     "FROM split_entries"),
                                             ("st", "SELECT row_pos, path || chr(9) || '1' AS line FROM split_images"),
                                             ("n", "SELECT count(*) AS n FROM split_images")])
_DEALT_CTE = ("dealt", f"""SELECT lab.row_pos, lab.row_pos * 4 // n.n AS block,
  {_FOLDER_SQL}[lab.row_pos * 4 // n.n + 1] AS folder,
  {_FOLDER_SQL}[lab.row_pos * 4 // n.n + 1] || '/' || regexp_extract(split_part(lab.line, chr(9), 1), '[^/]*$', 0)
    || chr(9) || substring(lab.line, strpos(lab.line, chr(9)) + 1) AS label_line,
  {_FOLDER_SQL}[lab.row_pos * 4 // n.n + 1] || '/' || regexp_extract(split_part(lab.line, chr(9), 1), '[^/]*$', 0)
    || chr(9) || substring(st.line, strpos(st.line, chr(9)) + 1) AS state_line
FROM lab JOIN st ON lab.row_pos = st.row_pos, n""")


@register("zip3", _SPLIT_BASE +
          "SELECT i.row_pos, i.path AS img_path, lab.line AS label_line, st.line AS state_line "
          "FROM split_images i JOIN lab ON lab.row_pos = i.row_pos JOIN st ON st.row_pos = i.row_pos")
def q_zip3(spark, sf_dir):
    imgs, lab, st = split_inputs(spark, sf_dir)
    return align.zip_by_position([imgs.select("row_pos", F.col("path").alias("img_path")),
                                  lab.select("row_pos", F.col("line").alias("label_line")),
                                  st.select("row_pos", F.col("line").alias("state_line"))])


@register("alignment_check", _SPLIT_BASE +
          "SELECT *, n_images > 0 AND n_label = n_images AND n_state = n_images AND bad_label = 0 AND bad_state = 0 AS ok FROM ("
          "SELECT n.n AS n_images, (SELECT count(*) FROM lab) AS n_label, "
          "(SELECT count(*) FROM lab WHERE strpos(line, chr(9)) = 0) AS bad_label, (SELECT count(*) FROM st) AS n_state, "
          "(SELECT count(*) FROM st WHERE strpos(line, chr(9)) = 0) AS bad_state, 4::bigint AS k FROM n) c")
def q_alignment_check(spark, sf_dir):
    imgs, lab, st = split_inputs(spark, sf_dir)
    return pages.alignment_summary(imgs, lab, st, len(FOLDERS))


@register("path_rewrite", _SPLIT_BASE.rstrip() + ",\n" + f"{_DEALT_CTE[0]} AS ({_DEALT_CTE[1]})\n" +
          "SELECT row_pos, folder, label_line, state_line FROM dealt")
def q_path_rewrite(spark, sf_dir):
    _, lab, st = split_inputs(spark, sf_dir)
    return pages.deal_out(lab, st, FOLDERS).select("row_pos", "folder", "label_line", "state_line")


@register("copy_manifest", _SPLIT_BASE.rstrip() + ",\n" + f"{_DEALT_CTE[0]} AS ({_DEALT_CTE[1]})\n" +
          """SELECT d.row_pos, d.folder, split_part(d.label_line, chr(9), 1) AS dst, f.src,
  CASE WHEN f.src IS NULL THEN 'missing' ELSE 'copy' END AS status
FROM dealt d LEFT JOIN (SELECT regexp_extract(path, '[^/]*$', 0) AS b, arg_min(path, row_pos) AS src
  FROM split_images GROUP BY 1) f ON f.b = regexp_extract(split_part(d.label_line, chr(9), 1), '[^/]*$', 0)""")
def q_copy_manifest(spark, sf_dir):
    imgs, lab, st = split_inputs(spark, sf_dir)
    return pages.copy_manifest(pages.deal_out(lab, st, FOLDERS), imgs)


@register("missing_images", with_ctes("page_files", extra=[OCR_PAGES_CTE, SPLIT_IMAGES_CTE]) +
          f"SELECT o.row_pos, {_BASE.replace('path', 'o.path')} AS image FROM ocr_pages o "
          f"WHERE {_BASE.replace('path', 'o.path')} NOT IN (SELECT {_BASE} FROM split_images)")
def q_missing_images(spark, sf_dir):
    lab = pages.file_state_lines(ocr_pages(spark, sf_dir))
    return pages.missing_images(lab, split_images(spark, sf_dir)).select("row_pos", "image")


_RESUME_SQL = (with_ctes("page_files", extra=[OCR_PAGES_CTE]) +
          """SELECT doc, page, doc || '_page_' || page || '.png' AS page_name FROM (
  SELECT DISTINCT CASE WHEN starts_with(regexp_extract(path, '[^/]*$', 0), 'chapter4_') THEN 'chapter4' ELSE 'chapter12' END AS doc,
         try_cast(regexp_extract(path, '_page_([0-9]+)\\.[^./]*$', 1) AS bigint) AS page FROM page_files) e
WHERE page IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ocr_pages o WHERE o.doc = e.doc AND o.page = e.page)""")


def _expected_and_done(spark, sf_dir):
    files = page_files(spark, sf_dir)
    base = F.substring_index("path", "/", -1)
    expected = files.select(
        F.when(base.startswith("chapter4_"), F.lit("chapter4")).otherwise(F.lit("chapter12")).alias("doc"),
        F.regexp_extract("path", r"_page_([0-9]+)\.[^./]*$", 1).try_cast("bigint").alias("page")).where(
            F.col("page").isNotNull()).distinct()
    return expected, ocr_pages(spark, sf_dir).select("doc", "page")


@register("resume_todo", _RESUME_SQL)
def q_resume_todo(spark, sf_dir):
    expected, done = _expected_and_done(spark, sf_dir)
    todo = pages.resume_todo(expected, done, ["doc", "page"])
    return todo.select("doc", "page", pages.page_file_name("doc", "page").alias("page_name"))


@register("resume_large_done", _RESUME_SQL)
def q_resume_large_done(spark, sf_dir):
    """The done list also holds a hundred pages of other documents for each expected one."""
    expected, done = _expected_and_done(spark, sf_dir)
    # dealt out before each page becomes a hundred rows; a hash of its own, as the key's partitioning would be merged into few
    spread = expected.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("doc", "page"))
    others = spread.selectExpr("doc", "page", "explode(sequence(1, 100)) AS i").selectExpr("concat(doc, '_v', i) AS doc", "page")
    todo = pages.resume_todo(expected, done.unionByName(others), ["doc", "page"], large_done=True)
    return todo.select("doc", "page", pages.page_file_name("doc", "page").alias("page_name"))
