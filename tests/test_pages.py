import json

import pytest
from pyspark.sql import functions as F

from curatio.operators import pages

FOLDERS = ["A", "B", "C", "D"]


def test_page_order_numbers_then_unnumbered(spark):
    files = spark.createDataFrame([("r/c_page_x.png",), ("r/c_page_10.png",), ("r/c_page_2.JPG",),
                                   ("r/c_page_3.tiff",), ("r/other_page_1.png",)], "path string")
    listing = pages.list_pages(files, ["pdfs/c.pdf"], folders=["r"])
    got = [r.path for r in pages.order_pages(listing).orderBy("row_pos").collect()]
    assert got == ["r/c_page_2.JPG", "r/c_page_10.png", "r/c_page_x.png"]


def test_doc_name_and_prefix(spark):
    df = spark.createDataFrame([("a/b/chapter4.pdf",), ("x.tar.gz",), (".bashrc",), ("..a",), ("noext",)],
                               "path string")
    got = [r.d for r in df.select(pages.doc_name("path").alias("d")).collect()]
    assert got == ["chapter4", "x.tar", ".bashrc", "..a", "noext"]
    df2 = spark.createDataFrame([("raw/Ab1_page_3.JPEG",), ("raw/a-b_page_3.png",), ("raw/ab_page_x.png",)],
                                "path string")
    assert [r.p for r in df2.select(pages.page_prefix("path").alias("p")).collect()] == \
        ["Ab1", "unknownprefix", "unknownprefix"]


def test_bbox_clamped(spark):
    df = spark.createDataFrame([([[-3, 1], [9, 1], [9, 12], [-3, 12]],)], "points array<array<int>>")
    x0, y0, x1, y1 = pages.polygon_bbox("points", 8, 10)
    r = df.select(x0.alias("a"), y0.alias("b"), x1.alias("c"), y1.alias("d")).collect()[0]
    assert (r.a, r.b, r.c, r.d) == (0, 1, 8, 10)


def _entries_fixture(spark):
    pgs = spark.createDataFrame([(0, "r/a.png"), (1, "r/b.png"), (2, "r/c.png")],
                                "row_pos long, path string")
    dets = spark.createDataFrame([("r/a.png", 0, [[1, 2], [3, 4]]), ("r/a.png", 1, [[5, 6], [7, 8]]),
                                  ("r/c.png", 0, [[0, 0], [1, 1]])],
                                 "path string, poly_idx long, points array<array<int>>")
    recs = spark.createDataFrame([(0, "t0"), (1, "t1"), (2, "t2")], "crop_pos long, text string")
    return pages.page_entries(pgs, dets, recs)


def test_regroup_by_running_offset(spark):
    got = {r.path: [e.transcription for e in r.entries] for r in _entries_fixture(spark).collect()}
    assert got == {"r/a.png": ["t0", "t1"], "r/b.png": [], "r/c.png": ["t2"]}


def test_label_line_is_reference_json(spark):
    lines = {r.row_pos: r.line for r in pages.label_lines(_entries_fixture(spark)).collect()}
    path, js = lines[0].split("\t", 1)
    expect = [{"transcription": "t0", "points": [[1, 2], [3, 4]], "difficult": False},
              {"transcription": "t1", "points": [[5, 6], [7, 8]], "difficult": False}]
    assert path == "r/a.png" and js == json.dumps(expect, ensure_ascii=False)
    assert lines[1] == "r/b.png\t[]"


def test_rec_gt_names(spark):
    e = _entries_fixture(spark).withColumn("path", F.regexp_replace("path", r"r/(\w)\.png", "r/$1_page_7.png"))
    got = sorted(r.line for r in pages.rec_gt_lines(e).collect())
    assert got[0] == "crop_img/a_page_7_crop_0.jpg\tt0"
    legacy = sorted(r.line for r in pages.rec_gt_lines(e, legacy_names=True).collect())
    assert legacy[0] == "crop_img/a_page_1_crop_0.jpg\tt0"


def test_deal_out_and_manifest(spark):
    n = 10
    lab = spark.createDataFrame([(i, f"old/p{i}.png\t[]") for i in range(n)], "row_pos long, line string")
    st = spark.createDataFrame([(i, f"old/p{i}.png\t1") for i in range(n)], "row_pos long, line string")
    d = pages.deal_out(lab, st, FOLDERS).orderBy("row_pos").collect()
    assert [r.folder for r in d] == ["A"] * 3 + ["B"] * 2 + ["C"] * 3 + ["D"] * 2
    assert d[0].label_line == "A/p0.png\t[]" and d[9].state_line == "D/p9.png\t1"
    imgs = spark.createDataFrame([(0, "x/p1.png"), (1, "y/p1.png"), (2, "x/p2.png")], "row_pos long, path string")
    m = {r.dst: (r.src, r.status) for r in pages.copy_manifest(pages.deal_out(lab, st, FOLDERS), imgs).collect()}
    assert m["A/p1.png"] == ("x/p1.png", "copy") and m["A/p0.png"] == (None, "missing")


def test_deal_out_needs_tab(spark):
    lab = spark.createDataFrame([(0, "no tab here")], "row_pos long, line string")
    st = spark.createDataFrame([(0, "p\t1")], "row_pos long, line string")
    with pytest.raises(Exception):
        pages.deal_out(lab, st, FOLDERS).collect()


def test_alignment_summary(spark):
    imgs = spark.createDataFrame([(0, "a")], "row_pos long, path string")
    good = spark.createDataFrame([(0, "a\t1")], "row_pos long, line string")
    assert pages.alignment_summary(imgs, good, good, 4).collect()[0].ok
    two = spark.createDataFrame([(0, "a\t1"), (1, "b\t1")], "row_pos long, line string")
    with pytest.raises(Exception):
        pages.alignment_summary(imgs, two, good, 4).collect()


def test_doc_text_in_page_order(spark):
    rows = [("d", p, f"<{p}>") for p in [3, 1, 2, 1500, 1024]]
    df = spark.createDataFrame(rows, "doc string, page long, text string")
    r = pages.doc_text(df, chunk_pages=1024).collect()[0]
    assert r.text == "<1><2><3><1024><1500>" and r.n_pages == 5


def test_resume_per_item(spark):
    expected = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc string, page long")
    done = spark.createDataFrame([("d", 2), ("d", 2)], "doc string, page long")
    todo = pages.resume_todo(expected, done, ["doc", "page"])
    assert sorted(r.page for r in todo.collect()) == [1, 3]
    flags = spark.range(1).select(pages.all_done(todo).alias("a"),
                                  pages.all_done(todo.where("page > 5")).alias("b")).collect()[0]
    assert (flags.a, flags.b) == (False, True)


def test_duplicate_page_path_last_wins_at_first_position(spark):
    """An image listed twice is detected and recognised twice; the later strings stay."""
    pgs = spark.createDataFrame([(0, "r/a.png"), (1, "r/b.png"), (2, "r/a.png")], "row_pos long, path string")
    dets = spark.createDataFrame([("r/a.png", 0, [[0, 0]]), ("r/a.png", 1, [[2, 2]])],
                                 "path string, poly_idx long, points array<array<int>>")
    recs = spark.createDataFrame([(0, "old"), (1, "old1"), (2, "new0"), (3, "new1")], "crop_pos long, text string")
    got = {r.path: (r.row_pos, [e.transcription for e in r.entries])
           for r in pages.page_entries(pgs, dets, recs).collect()}
    assert got == {"r/a.png": (0, ["new0", "new1"]), "r/b.png": (1, [])}


def test_too_few_strings_same_numbers_and_no_number(spark):
    """Two documents with the same page numbers, a page without number, fewer strings than polygons."""
    names = ["r/a_page_1.png", "r/a_page_x.png", "r/b_page_1.png", "r/b_page_2.png"]
    pgs = spark.createDataFrame(list(enumerate(names)), "row_pos long, path string")
    dets = spark.createDataFrame([(n, i, [[i, i]]) for n in names[:3] for i in range(2)],
                                 "path string, poly_idx long, points array<array<int>>")
    recs = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "crop_pos long, text string")
    e = pages.page_entries(pgs, dets, recs)
    assert [[x.transcription for x in r.entries] for r in e.orderBy("row_pos").collect()] == \
        [["t0", "t1"], ["t2", "t3"], ["t4"], []]
    crops = pages.crop_table(pgs, dets, 1, 1).orderBy("crop_pos").collect()
    assert [(r.crop_pos, r.crop) for r in crops][2:4] == [
        (2, "crop_img/unknownprefix_page_2_crop_0.jpg"), (3, "crop_img/unknownprefix_page_2_crop_1.jpg")]
    assert [r.max_x for r in crops] == [0, 1] * 3


def test_pages_meet_their_strings_whatever_the_block(spark):
    """Pages that span blocks, share one, have no polygon or no string; a path listed twice."""
    sizes = [3, 0, 1, 7, 2]
    imgs = spark.createDataFrame([(i, f"p{i}.png") for i in range(5)] + [(5, "p2.png")], "row_pos long, path string")
    dets = spark.createDataFrame([(f"p{i}.png", k, [[i, k]]) for i, n in enumerate(sizes) for k in range(n)], "path string, poly_idx long, points array<array<int>>")
    texts = spark.createDataFrame([(c, None if c == 4 else f"t{c}") for c in range(14) if c != 1], "crop_pos long, text string")
    want = {0: [("t0", 0), ("t2", 2)], 1: [], 2: [("t13", 0)], 3: [(f"t{4 + k}", k) for k in range(1, 7)], 4: [("t11", 0), ("t12", 1)]}
    for block in (1, 2, 3, 1024):
        got = pages.page_entries(imgs, dets, texts, block=block).collect()
        assert {r.row_pos: [(e.transcription, e.points[0][1]) for e in r.entries] for r in got} == want
        assert all(r.n_entries == len(r.entries) for r in got)


def test_resume_against_a_long_done_list(spark):
    expected = spark.createDataFrame([(f"d{i % 5}", i if i % 11 else None) for i in range(300)], "doc string, page long")
    done = spark.range(60_000).select(F.concat(F.lit("d"), (F.col("id") % 5).cast("string")).alias("doc"), (F.col("id") * 2).alias("page"), F.lit(1).alias("x"))
    plain = sorted(map(str, pages.resume_todo(expected, done, ["doc", "page"]).collect()))
    assert sorted(map(str, pages.resume_todo(expected, done, ["doc", "page"], large_done=True).collect())) == plain and 100 < len(plain) < 300
    near = pages.possibly_listed(done, expected.distinct(), ["doc", "page"])
    hits = done.join(expected.distinct(), ["doc", "page"], "left_semi").count()
    assert hits <= near.count() < hits + 0.1 * done.count()
    assert pages.resume_todo(expected.limit(0), done, ["doc", "page"], large_done=True).count() == 0


def test_more_expected_items_than_full_bitmaps_serve(spark, monkeypatch):
    """The bitmaps stop growing, lose no item, and are looked into as numbers."""
    monkeypatch.setattr(pages, "MAX_BITS", 1 << 15)
    expected = spark.range(8000).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("doc"), F.col("id").alias("page"))
    done = spark.range(40_000).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("doc"), (F.col("id") * 5).alias("page"))
    near = pages.possibly_listed(done, expected, ["doc", "page"])
    hits = done.join(expected, ["doc", "page"], "left_semi")
    assert hits.count() > 500 and hits.subtract(near).isEmpty() and near.count() < 0.4 * done.count()
    assert "conv(" not in near._jdf.queryExecution().optimizedPlan().toString()
    plain = sorted(map(str, pages.resume_todo(expected, done, ["doc", "page"]).collect()))
    assert sorted(map(str, pages.resume_todo(expected, done, ["doc", "page"], large_done=True).collect())) == plain


def test_a_block_of_crops_gets_its_own_polygons_only(spark):
    listed = spark.createDataFrame([(0, "raw/a_page_1.png"), (1, "raw/a_page_2.png")], "row_pos long, path string")
    dets = spark.createDataFrame([("raw/a_page_1.png", 0, [[0, 0]])] + [("raw/a_page_2.png", i, [[i, i]]) for i in range(5)],
                                 "path string, poly_idx long, points array<array<int>>")
    texts = spark.createDataFrame([(0, "t0"), (1, "t1"), (2, None), (3, "t3"), (5, "t5")], "crop_pos long, text string")
    out = pages.page_entries(listed, dets, texts, block=2)
    got = {r.row_pos: [(e.transcription, [list(p) for p in e.points]) for e in r.entries] for r in out.collect()}
    assert got == {0: [("t0", [[0, 0]])], 1: [("t1", [[0, 0]]), ("t3", [[2, 2]]), ("t5", [[4, 4]])]}
    assert "slice(_polys" in out._jdf.queryExecution().optimizedPlan().toString()


def test_polygons_are_shuffled_once_and_never_stored(spark):
    """Offsets are summed over narrow rows; strings go to the polygons, by shuffle joins whatever the files' size."""
    from curatio.operators.positions import stored
    listed = spark.createDataFrame([(0, "a.png"), (1, None), (2, "b.png"), (3, "c.png")], "row_pos long, path string")
    rows = [("a.png", i, [[i, 0]]) for i in (2, 0, 1)] + [("b.png", i, [[i, 1]]) for i in range(4)] + [(None, 0, [[9, 9]]), ("d.png", 0, [[8, 8]])]
    dets = stored(spark.createDataFrame(rows, "path string, poly_idx long, points array<array<int>>"), "dets")
    texts = stored(spark.createDataFrame([(c, f"t{c}") for c in (0, 2, 3, 6, 6, 7, 40)] + [(None, "x")], "crop_pos long, text string"), "texts")
    for twice in (True, False):
        out = pages.page_entries(listed, dets, texts, dedupe_paths=twice, block=2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("partial_collect_list(struct(poly_idx") == 1 and not any("_polys" in line for line in plan.splitlines() if "ExistingRDD" in line)
        assert plan.count("SortMergeJoin") == 3
        got = {(r.row_pos, r.path): [(e.transcription, e.points[0][0]) for e in r.entries] for r in out.collect()}
        assert got == {(0, "a.png"): [("t0", 0), ("t2", 2)], (1, None): [], (2, "b.png"): [("t3", 0), ("t6", 3), ("t6", 3)], (3, "c.png"): []}
