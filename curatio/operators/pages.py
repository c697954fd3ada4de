"""Page-annotation preparation.

Inputs are tables: a file listing (path), detections (path, poly_idx, points), recognised
strings in flattened crop order (crop_pos, text), page texts (doc, page, text).  Images,
PDFs and models are outside Spark; their outputs are the rows here.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.functions.text import basename
from curatio.operators.align import _fail_when
from curatio.operators.positions import dense_positions, materialize, running_offsets

# --- fixed values -----------------------------------------------------------------------
PAGE_EXTS = ("png", "jpg", "jpeg")                    # page images, any case
SPLIT_GLOB_EXTS = ("png", "jpg", "jpeg", "bmp", "tiff")  # split listing, exact case
UNKNOWN_PREFIX = "unknownprefix"
PAGE_NUM_RE = r"(?i)^.*page_([0-9]+)\.(png|jpg|jpeg)$"
PREFIX_RE = r"(?i)^([a-zA-Z0-9]+)_page_[0-9]+\.(png|jpg|jpeg)$"
STEM_RE = r"^(.*[^.].*)\.[^.]*$"
STATE_DONE = "1"
CROP_FOLDER = "crop_img"
# -----------------------------------------------------------------------------------------

MAX_BITS = 1 << 29      # bits of the broadcast bitmaps of expected items: 64 MB; they serve up to a quarter as many items
CROP_BLOCK = 32         # crop positions of one block in which recognitions meet their pages: each page looks through its blocks


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doc_name(path) -> Column:
    """Base name without its last extension; a name of only leading dots keeps them."""
    b = basename(_c(path))
    return F.when(b.rlike(STEM_RE), F.regexp_extract(b, STEM_RE, 1)).otherwise(b)


def page_number(path) -> Column:
    """``…page_<n>.(png|jpg|jpeg)``, any case; NULL (sorts last) when absent."""
    digits = F.regexp_extract(basename(_c(path)), PAGE_NUM_RE, 1)
    return F.when(digits == "", F.lit(None).cast("bigint")).otherwise(digits.try_cast("bigint"))


def page_prefix(path) -> Column:
    pre = F.regexp_extract(basename(_c(path)), PREFIX_RE, 1)
    return F.when(pre == "", F.lit(UNKNOWN_PREFIX)).otherwise(pre)


def page_file_name(doc, page) -> Column:
    return F.concat(_c(doc), F.lit("_page_"), _c(page).cast("string"), F.lit(".png"))


def _quote(text: str) -> str:
    """A literal inside a Java regex."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _match_docs(files: DataFrame, rules: list[tuple[int, str, str, str]], ext_re: str,
                path_col: str) -> DataFrame:
    """Rows of ``files`` tagged with each (order, doc, folder, name prefix) rule they match.

    A file matches a rule when it sits directly in the folder, its name starts with the
    prefix and ends with one of the extensions.  When no two rules can match the same file
    (different folders, or neither prefix starts the other) one anchored regular expression
    per row finds the rule: cheap even when the optimizer evaluates it below a distinct.
    Otherwise an explode keeps one row per matching rule, as listing each folder
    separately would.
    """
    overlap = any(fa == fb and (pa.startswith(pb) or pb.startswith(pa))
                  for i, (_, _, fa, pa) in enumerate(rules) for (_, _, fb, pb) in rules[i + 1:])
    heads = [f"{fo}/{pre}" if fo else pre for _, _, fo, pre in rules]
    if not overlap:
        pattern = "^(" + "|".join(_quote(h) for h in heads) + ")[^/]*" + ext_re + "$"
        head = F.regexp_extract(F.col(path_col), pattern, 1)
        order = doc = None
        for (o, d, _, _), h in zip(rules, heads):
            c = head == F.lit(h)
            order = F.when(c, F.lit(o)) if order is None else order.when(c, F.lit(o))
            doc = F.when(c, F.lit(d)) if doc is None else doc.when(c, F.lit(d))
        return (files.select(order.alias("doc_order"), doc.alias("doc"), F.col(path_col).alias("path"))
                .where(F.col("doc_order").isNotNull()))
    hits = [F.when(F.col(path_col).rlike("^" + _quote(h) + "[^/]*" + ext_re + "$"),
                   F.struct(F.lit(o).alias("doc_order"), F.lit(d).alias("doc")))
            for (o, d, _, _), h in zip(rules, heads)]
    return (files.withColumn("_hit", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
            .select(F.col("_hit.doc_order").alias("doc_order"), F.col("_hit.doc").alias("doc"),
                    F.col(path_col).alias("path")))


def _ext_re(exts: Sequence[str], any_case: bool) -> str:
    alt = "|".join(_quote(e) for e in exts)
    return r"\.(?i:" + alt + ")" if any_case else r"\.(?:" + alt + ")"


def list_pages(files: DataFrame, pdf_paths: Sequence[str], folders: Sequence[str] | None = None,
               path_col: str = "path") -> DataFrame:
    """Page images of each document: ``{doc}_page_*`` with png/jpg/jpeg in any case.

    One pass over the listing; a file matching several documents appears once per document,
    as listing each folder separately would give.  Adds doc_order, doc, page.
    """
    docs = [os.path.splitext(os.path.basename(p))[0] for p in pdf_paths]
    folders = list(folders) if folders else ["raw"] * len(docs)
    rules = [(i, d, fo, f"{d}_page_") for i, (d, fo) in enumerate(zip(docs, folders))]
    return _match_docs(files, rules, _ext_re(PAGE_EXTS, True), path_col).withColumn("page", page_number("path"))


def list_split_images(files: DataFrame, prefixes: Sequence[str],
                      folders: Sequence[str] | None = None, exts: Sequence[str] = SPLIT_GLOB_EXTS,
                      path_col: str = "path") -> DataFrame:
    """Images for dealing out: exact-case extensions, one name prefix and folder per document."""
    folders = list(folders) if folders else ["raw"] * len(prefixes)
    rules = [(i, pre, fo, pre) for i, (pre, fo) in enumerate(zip(prefixes, folders))]
    return _match_docs(files, rules, _ext_re(exts, False), path_col).withColumn("page", page_number("path"))


def order_pages(listing: DataFrame, out_col: str = "row_pos") -> DataFrame:
    """Documents in configured order, pages by number (unnumbered last), ties by path."""
    return dense_positions(listing, [F.col("doc_order"), F.col("page").asc_nulls_last(), F.col("path")], out_col)


def polygon_bbox(points, width, height) -> tuple[Column, Column, Column, Column]:
    """Axis-aligned box of a polygon, truncated to int and clamped to the image."""
    pts = F.transform(_c(points), lambda p: F.transform(p, lambda v: v.cast("int")))
    xs = F.transform(pts, lambda p: F.get(p, 0))
    ys = F.transform(pts, lambda p: F.get(p, 1))
    w, h = _c(width) if not isinstance(width, int) else F.lit(width), \
        _c(height) if not isinstance(height, int) else F.lit(height)
    return (F.greatest(F.array_min(xs), F.lit(0)), F.greatest(F.array_min(ys), F.lit(0)),
            F.least(F.array_max(xs), w), F.least(F.array_max(ys), h))


def page_crops(pages: DataFrame, detections: DataFrame, key: str = "path") -> DataFrame:
    """One row per polygon of the listed images: the detections with row_pos and crop_pos.

    An image's first crop is the number of crops of earlier pages (W04, distributed prefix
    sum).  An image listed twice is detected twice, as two pages.
    """
    counts = detections.groupBy(key).agg(F.count(F.lit(1)).alias("n_crops"))
    pc = pages.select("row_pos", key).join(counts, key).select("row_pos", key, "n_crops")
    pc = running_offsets(pc, ["row_pos"], "n_crops", "_off")
    return (detections.join(pc.select(key, "row_pos", "_off"), key)
            .withColumn("crop_pos", F.col("_off") + F.col("poly_idx")).drop("_off"))


def page_entries(pages: DataFrame, detections: DataFrame, recognitions: DataFrame,
                 key: str = "path", dedupe_paths: bool = True, block: int = CROP_BLOCK) -> DataFrame:
    """One record per page: ``[{transcription, points, difficult:false}, …]`` in polygon order.

    ``pages`` (row_pos, path); ``detections`` (path, poly_idx, points), the polygons of each
    image numbered from 0, whatever its page number; ``recognitions`` (crop_pos, text) in flattened crop
    order over pages by row_pos.  A polygon with no recognised string is dropped (zip to the
    shorter list); a page with no polygons keeps ``[]``.  A path listed twice keeps the
    later page's entries at the earlier position.

    A page is the interval of crop positions from its offset on.  Recognitions meet the pages by
    blocks of ``block`` crop positions, a page with each block that its interval touches; only the
    strings go on to the page's image, where its polygons are gathered (a detector bounds them): each
    polygon is shuffled once.  ``detections`` is read twice, first to count: store it if it is costly to make.
    """
    counts = detections.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    held = pages.select(*dict.fromkeys(["row_pos", "path", key])).join(counts, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    held = running_offsets(held, ["row_pos"], "_n", "_off")
    if dedupe_paths:
        # narrow rows: which page of a path gives the entries, and where they go
        last = F.max_by(F.struct(F.col(key).alias("_key"), "_off", "_n"), "row_pos").alias("_last")
        held = held.groupBy("path").agg(F.min("row_pos").alias("row_pos"), last)
        own = F.col("path" if key == "path" else "_last._key").alias("_key")
        held = held.select("path", "row_pos", own, "_last._off", "_last._n")
    else:
        held = held.select("path", "row_pos", F.col(key).alias("_key"), "_off", "_n")
    page = ["_key"] if dedupe_paths and key == "path" else ["_key", "row_pos"]

    spans = held.where("_n > 0").select(*page, "_off", "_n", F.explode(F.expr(f"sequence(_off div {block}, (_off + _n - 1) div {block})")).alias("_block"))
    spans = spans.withColumn("_first", F.greatest(F.col("_off"), F.col("_block") * block))
    spans = spans.withColumn("_end", F.least(F.col("_off") + F.col("_n"), (F.col("_block") + 1) * block)).drop("_off", "_n")
    strings = (recognitions.where("text IS NOT NULL").groupBy(F.expr(f"crop_pos div {block}").alias("_block"))
               .agg(F.sort_array(F.collect_list(F.struct("crop_pos", "text"))).alias("_texts")))
    mine = F.filter("_texts", lambda r: (r["crop_pos"] >= F.col("_first")) & (r["crop_pos"] < F.col("_end")))
    mine = F.transform(mine, lambda r: F.struct((r["crop_pos"] - F.col("_first")).cast("int").alias("i"), r["text"].alias("text")))
    # never a broadcast: the size of compact files says little of the strings' size
    parts = spans.join(strings.hint("merge"), "_block").select(*page, "_first", mine.alias("_texts")).where(F.size("_texts") > 0)
    parts = parts.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("_first", "_texts"))).alias("_parts"))
    polygons = (detections.select(F.col(key).alias("_key"), "poly_idx", "points").groupBy("_key")
                .agg(F.sort_array(F.collect_list(F.struct("poly_idx", "points"))).alias("_polys")))

    def entries(part: Column) -> Column:
        own = F.slice("_polys", (part["_first"] - F.col("_off") + 1).cast("int"), F.lit(block))       # a block gets its own polygons only
        return F.transform(part["_texts"], lambda r: F.struct(r["text"].alias("transcription"), F.get(own, r["i"])["points"].alias("points"),
                                                              F.lit(False).alias("difficult")))
    out = held.join(polygons.hint("merge"), "_key", "left").join(parts.hint("merge"), page, "left")
    out = out.select("path", "row_pos", F.flatten(F.transform("_parts", entries)).alias("entries"))
    out = out.withColumn("entries", F.coalesce("entries", F.array().cast(out.schema["entries"].dataType)))
    return out.withColumn("n_entries", F.size("entries").cast("bigint"))


def crop_names(row_pos="row_pos", path="path", poly_idx="poly_idx", crop_folder: str = CROP_FOLDER,
               legacy_names: bool = False, batch_size: int = 4) -> Column:
    """Crop file ``{prefix}_page_{n}_crop_{i}.jpg``; n as in ``rec_gt_lines``."""
    n = ((F.pmod(_c(row_pos), F.lit(batch_size)) + 1) if legacy_names
         else F.coalesce(page_number(path), _c(row_pos) + 1))
    name = F.concat(page_prefix(path), F.lit("_page_"), n.cast("string"), F.lit("_crop_"),
                    _c(poly_idx).cast("string"), F.lit(".jpg"))
    return F.concat(F.lit(crop_folder.rstrip("/") + "/"), name) if crop_folder else name


def crop_table(pages: DataFrame, detections: DataFrame, width, height, key: str = "path",
               crop_folder: str = CROP_FOLDER, legacy_names: bool = False, batch_size: int = 4) -> DataFrame:
    """What a cropper needs per polygon: image, crop file name, box clamped to the image (P14, P16)."""
    crops = page_crops(pages, detections, key)
    x0, y0, x1, y1 = polygon_bbox("points", width, height)
    return crops.select("row_pos", "crop_pos", "path", F.col("poly_idx").cast("bigint").alias("poly_idx"),
                        crop_names(crop_folder=crop_folder, legacy_names=legacy_names,
                                   batch_size=batch_size).alias("crop"),
                        x0.alias("min_x"), y0.alias("min_y"), x1.alias("max_x"), y1.alias("max_y"))


def entries_json(entries) -> Column:
    """Entries as the reference prints them (``json.dumps``: ", " and ": " separators)."""
    def one(e):
        t = F.to_json(F.array(e["transcription"]))
        tj = F.regexp_replace(t, r"(?s)^\[(.*)\]$", "$1")   # the JSON string of the text
        pts = F.concat(F.lit("["), F.array_join(F.transform(
            e["points"], lambda p: F.concat(F.lit("["), F.array_join(p, ", "), F.lit("]"))), ", "), F.lit("]"))
        return F.concat(F.lit('{"transcription": '), tj, F.lit(', "points": '), pts,
                        F.lit(', "difficult": '), F.when(e["difficult"], F.lit("true")).otherwise(F.lit("false")),
                        F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(_c(entries), one), ", "), F.lit("]"))


def label_lines(entries: DataFrame) -> DataFrame:
    """``path<TAB>json(entries)`` per page (Label.txt)."""
    return entries.select("row_pos", F.concat("path", F.lit("\t"), entries_json("entries")).alias("line"))


def file_state_lines(pages: DataFrame) -> DataFrame:
    """``path<TAB>1`` per image (fileState.txt)."""
    return pages.select("row_pos", F.concat("path", F.lit("\t" + STATE_DONE)).alias("line"))


def rec_gt_lines(entries: DataFrame, crop_folder: str = CROP_FOLDER, legacy_names: bool = False,
                 batch_size: int = 4) -> DataFrame:
    """``crop_path<TAB>text`` per polygon; crop ``{prefix}_page_{n}_crop_{i}.jpg``.

    n is the page number from the file name (position+1 when it has none);
    ``legacy_names`` reproduces numbering by index inside the batch.
    """
    e = entries.select("row_pos", "path", F.posexplode("entries").alias("poly_idx", "_e"))
    path = crop_names(crop_folder=crop_folder, legacy_names=legacy_names, batch_size=batch_size)
    return e.select("row_pos", F.col("poly_idx").cast("bigint").alias("poly_idx"),
                    F.concat(path, F.lit("\t"), F.col("_e.transcription")).alias("line"))


def doc_text(page_texts: DataFrame, chunk_pages: int = 1024) -> DataFrame:
    """Whole document text: page texts concatenated in page order.

    Two levels so no task gathers more than ``chunk_pages`` pages before the last step:
    page chunks are concatenated in parallel, then the chunk strings of a document.
    """
    chunk = F.floor(F.col("page") / F.lit(chunk_pages)).cast("bigint")
    parts = (page_texts.withColumn("_chunk", chunk)
             .groupBy("doc", "_chunk")
             .agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("_p"),
                  F.count(F.lit(1)).alias("_n"))
             .select("doc", "_chunk", "_n",
                     F.array_join(F.transform("_p", lambda x: x["text"]), "").alias("_t")))
    return (parts.groupBy("doc")
            .agg(F.sort_array(F.collect_list(F.struct("_chunk", "_t"))).alias("_c"),
                 F.sum("_n").cast("bigint").alias("n_pages"))
            .select("doc", "n_pages", F.array_join(F.transform("_c", lambda x: x["_t"]), "").alias("text")))


# --- dealing out work (split) -------------------------------------------------------------

def split_tab(line) -> tuple[Column, Column]:
    parts = F.split(_c(line), "\t", 2)
    return F.get(parts, 0), F.get(parts, 1)


def alignment_summary(images: DataFrame, label: DataFrame, state: DataFrame, k: int,
                      fail: bool = True) -> DataFrame:
    """One row of input checks: non-empty, equal lengths, a tab on every line; each input is read once."""
    def side(df: DataFrame, name: str, bare: Column) -> DataFrame:
        return df.select(F.lit(name).alias("side"), bare.alias("bare"))
    no_tab = F.instr("line", "\t") == 0
    rows = side(images, "images", F.lit(False)).unionByName(side(label, "label", no_tab)).unionByName(side(state, "state", no_tab))

    def n(name: str, only_bare: bool = False) -> Column:
        return F.count(F.when((F.col("side") == name) & (F.col("bare") if only_bare else F.lit(True)), 1)).cast("bigint")
    s = rows.agg(n("images").alias("n_images"), n("label").alias("n_label"), n("label", True).alias("bad_label"),
                 n("state").alias("n_state"), n("state", True).alias("bad_state")).withColumn("k", F.lit(k).cast("bigint"))
    ok = ((F.col("k") > 0) & (F.col("n_images") > 0) & (F.col("n_label") == F.col("n_images"))
          & (F.col("n_state") == F.col("n_images")) & (F.col("bad_label") == 0) & (F.col("bad_state") == 0))
    s = s.withColumn("ok", ok)
    return _fail_when(s, ~F.col("ok"), "split inputs are empty, differ in length or lack a tab") if fail else s


def deal_out(label: DataFrame, state: DataFrame, folders: Sequence[str]) -> DataFrame:
    """Zip label and state lines by position, give each a folder ``pos*k//n`` and rewrite paths.

    The new path is ``folder/basename(old path of the label line)``; the state line reuses
    it.  A line without a tab stops the job.  The zipped lines are checkpointed and counted
    there, so each input runs once.
    """
    from curatio.operators.align import zip_by_position
    from curatio.operators.positions import equal_blocks

    z = materialize(zip_by_position([label.select("row_pos", F.col("line").alias("label_line")),
                                     state.select("row_pos", F.col("line").alias("state_line"))]), "zipped")
    z = equal_blocks(z, len(folders), "row_pos", "block")
    names = F.array(*[F.lit(f) for f in folders])
    old, rest = split_tab("label_line")
    _, rest2 = split_tab("state_line")
    z = _fail_when(z, rest.isNull() | rest2.isNull(), "a label or state line has no tab")
    new_path = F.concat(F.get(names, F.col("block").cast("int")), F.lit("/"), basename(old))
    return z.select("row_pos", "block", F.get(names, F.col("block").cast("int")).alias("folder"),
                    F.concat(new_path, F.lit("\t"), rest).alias("label_line"),
                    F.concat(new_path, F.lit("\t"), rest2).alias("state_line"))


def copy_manifest(dealt: DataFrame, images: DataFrame) -> DataFrame:
    """Per rewritten label line: the first listed image with that base name, or missing."""
    first = (images.withColumn("_b", basename("path"))
             .groupBy("_b").agg(F.min_by("path", "row_pos").alias("src")))
    d = dealt.select("row_pos", "folder", F.get(F.split("label_line", "\t", 2), 0).alias("dst"))
    d = d.withColumn("_b", basename("dst"))
    return (d.join(first, "_b", "left")
            .select("row_pos", "folder", "dst", "src",
                    F.when(F.col("src").isNull(), F.lit("missing")).otherwise(F.lit("copy")).alias("status")))


def missing_images(label: DataFrame, images: DataFrame) -> DataFrame:
    """Label lines whose image base name is not among the listed images."""
    have = images.select(basename("path").alias("_b")).distinct()   # partial aggregate first
    lines = label.select("row_pos", basename(F.get(F.split("line", "\t", 2), 0)).alias("_b"))
    return lines.join(have, "_b", "left_anti").withColumnRenamed("_b", "image")


def possibly_listed(done: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of ``done`` without nearly all that aren't in ``listed`` (a small stored table of keys).

    A one-hash Bloom filter over the listed keys, 16 bits or more each up to ``MAX_BITS`` in all, as a table of
    bitmaps of 32,768 bits, 512 longs each; it is broadcast (4 bytes a key at most) and tested where ``done``
    is read, by a look into an array.
    """
    bits = min(MAX_BITS, 1 << max(15, (16 * listed.count() - 1).bit_length()))
    slot = F.pmod(F.xxhash64(*keys), F.lit(bits))
    word = F.expr("_slot div 64")
    set_bits = listed.select(slot.alias("_slot")).select(word.alias("_word"), F.expr("shiftleft(1L, int(_slot % 64))").alias("_bits"))
    words = set_bits.unionByName(listed.sparkSession.range(bits // 64).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_bits")))
    words = words.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    maps = words.groupBy(F.expr("_word div 512").alias("_bucket")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda x: x["_bits"]).alias("_map"))
    placed = done.select(*keys, slot.alias("_slot"))
    near = placed.select(*keys, F.expr("_slot div 32768").alias("_bucket"), F.expr("int(_slot % 32768)").alias("_bit"))
    near = near.join(F.broadcast(maps), "_bucket")
    return near.where(F.expr("bit_get(_map[_bit div 64], _bit % 64) = 1")).select(*keys)


def resume_todo(expected: DataFrame, done: DataFrame, keys: Sequence[str], large_done: bool = False) -> DataFrame:
    """Work items not yet done (per-item resume instead of all-or-nothing).

    ``large_done``: the done list is far longer than the expected one; only its items that may
    be expected ones are shuffled, up to ``MAX_BITS`` / 4 expected items.
    """
    if large_done:
        listed = materialize(expected.select(*keys).distinct(), "listed")
        if listed.count() <= MAX_BITS // 4:
            done = possibly_listed(done, listed, keys)
    return expected.join(done.select(*keys).distinct(), list(keys), "left_anti")


def all_done(todo: DataFrame) -> Column:
    """TRUE when nothing is left to do (a scalar subquery)."""
    return todo.select((F.count(F.lit(1)) == 0).alias("all_done")).scalar()


