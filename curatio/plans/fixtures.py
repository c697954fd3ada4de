"""Derived inputs with the reference's shapes, built by Spark from the given tables.

FIXTURES.md §3 defines them; these are the DataFrame forms.  Differences from that text:
split names are assigned by a rule on the key (every row kept), the NLI premise and
hypothesis are the two halves of the whole document text (no prefix cut), and the
un-partitioned ``row_number`` windows become distributed position operators.
Each builder has a DuckDB twin in ``curatio.plans.fixture_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatio.operators.positions import dense_positions
from curatio.sources.tables import table

NL = "\n"

# --- fixed values: split rules on the key ---------------------------------------------
# cqa / svamp: key % 5 = 4 -> test, else train
# nli:        key % 10 = 8 -> valid, key % 10 = 9 -> test, else train
# --------------------------------------------------------------------------------------


def split_rule_2(key) -> F.Column:
    return F.when(F.pmod(key, F.lit(5)) == 4, F.lit("test")).otherwise(F.lit("train"))


def split_rule_3(key) -> F.Column:
    m = F.pmod(key, F.lit(10))
    return F.when(m == 8, F.lit("valid")).when(m == 9, F.lit("test")).otherwise(F.lit("train"))


def cqa_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        split_rule_2(F.col("p_partkey")).alias("split"),
        F.col("p_partkey").alias("row_pos"),
        F.concat(F.lit("Which type is "), F.col("p_name"), F.lit("?")).alias("question"),
        F.col("p_type").alias("c0"), F.col("p_brand").alias("c1"), F.col("p_name").alias("c2"),
        F.col("p_size").cast("string").alias("c3"), F.lit("none").alias("c4"),
        F.col("p_type").alias("answer"))


def cqa_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.pmod(F.col("p_partkey"), F.lit(8)).cast("int")
    out = (F.when(k == 0, F.concat(F.lit("It is "), F.col("p_name"), F.lit(". So the answer is (a) "),
                                   F.col("p_type"), F.lit("." + NL + NL + "Q: next")))
           .when(k == 1, F.concat(F.lit("  Because "), F.col("p_name"), F.lit(" So the answer is (b) "),
                                  F.col("p_brand")))
           .when(k == 2, F.concat(F.lit("no marker "), F.col("p_name")))
           .when(k == 3, F.lit("x So the answer is (a) y So the answer is (b) z"))
           .when(k == 4, F.lit("r" + NL + "So the answer is desk."))
           .when(k == 5, F.concat(F.lit("r So the answer is (c) "), F.col("p_type"), F.lit(" (d) "),
                                  F.col("p_brand")))
           .when(k == 6, F.lit("Q: leading So the answer is (a) b"))
           .otherwise(F.lit("r So the answer is (e)  ")))
    return p.select(split_rule_2(F.col("p_partkey")).alias("split"),
                    F.col("p_partkey").alias("row_pos"), out.alias("output"))


def nli_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels")
    half = F.floor(F.length("text") / 2).cast("int")
    j = d.join(lab, "doc_id")
    return j.select(
        split_rule_3(F.col("doc_id")).alias("split"),
        F.col("doc_id").alias("row_pos"),
        F.col("text").substr(F.lit(1), half).alias("premise"),
        F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)").alias("hypothesis"),
        (F.col("quality") + F.col("toxic")).cast("int").alias("label"))


def nli_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    k = F.pmod(F.col("doc_id"), F.lit(6)).cast("int")
    word = F.when(F.col("quality") == 1, F.lit("neutral")).otherwise(F.lit("entailment"))
    out = (F.when(k == 0, F.concat(F.lit("R"), F.col("doc_id").cast("string"), F.lit("." + NL + "Answer: "),
                                   word, F.lit(NL + NL + "Premise: next")))
           .when(k == 1, F.lit("R Answer:neutral"))
           .when(k == 2, F.lit("R only"))
           .when(k == 3, F.lit("R Answer: "))
           .when(k == 4, F.lit("  R Answer: a Answer: b Premise"))
           .otherwise(F.concat(F.lit("R So the answer is "), word, F.lit("." + NL + "Premise: q"))))
    return lab.select(split_rule_3(F.col("doc_id")).alias("split"),
                      F.col("doc_id").alias("row_pos"), out.alias("output"))


LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def svamp_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(*LINEITEM_KEY, "l_quantity")
    li = dense_positions(li, LINEITEM_KEY, "row_pos", keep=["l_orderkey", "l_linenumber", "l_quantity"])
    q = F.col("l_quantity").cast("int")
    ln = F.col("l_linenumber")
    qs, lns = q.cast("string"), ln.cast("string")
    output = (F.when(ln == 1, F.lit("no marker"))
              .when(ln == 2, F.concat(F.lit("r The answer is ("), qs, F.lit(" / 0).")))
              .when(ln == 3, F.concat(F.lit("r The answer is ("), lns, F.lit(" * "), qs,
                                      F.lit(")." + NL + "Q: next")))
              .otherwise(F.concat(F.lit("r The answer is ("), qs, F.lit(" + "), lns, F.lit(")."))))
    llm_value = (F.when(ln <= 2, F.lit(None).cast("double"))
                 .when(ln == 3, (ln * q).cast("double"))
                 .otherwise((q + ln).cast("double")))
    return li.select(
        split_rule_2(F.col("row_pos")).alias("split"),
        "row_pos",
        F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" has "), qs,
                 F.lit(" boxes of "), lns, F.lit(".")).alias("body"),
        F.lit("How many items?").alias("question"),
        F.concat(F.lit("( "), qs, F.lit(" * "), lns, F.lit(" )")).alias("equation"),
        (q * ln).cast("double").alias("gold_value"),
        output.alias("output"),
        llm_value.alias("llm_value"))


def image_path(k) -> F.Column:
    """Page image of an order: two documents that share page numbers, some names without one."""
    chap = F.when(F.pmod(k, F.lit(2)) == 0, F.lit("4")).otherwise(F.lit("12"))
    number = (F.when(F.pmod(k, F.lit(50)) == 7, F.concat(F.lit("x"), k.cast("string")))
              .otherwise(F.floor(k / 2).cast("bigint").cast("string")))
    ext = (F.when(F.pmod(k, F.lit(3)) == 0, F.lit(".PNG"))
           .when(F.pmod(k, F.lit(3)) == 1, F.lit(".jpg")).otherwise(F.lit(".tiff")))
    return F.concat(F.lit("raw/chapter"), chap, F.lit("_page_"), number, ext)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per order; orders without line items are images without polygons."""
    return table(spark, sf_dir, "orders").select(image_path(F.col("o_orderkey")).alias("path")).distinct()


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector output: polygons of one page image, enumerated in order.

    The group is one image, whose polygon count the detector bounds, so a window
    partitioned by image is safe here (no image can hold a share of all rows).
    """
    li = table(spark, sf_dir, "lineitem").select(*LINEITEM_KEY, "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey)
    w = Window.partitionBy("l_orderkey").orderBy(*LINEITEM_KEY[1:])
    j = j.withColumn("poly_idx", (F.row_number().over(w) - 1).cast("bigint"))
    q = F.col("l_quantity").cast("int")
    return j.select(image_path(F.col("l_orderkey")).alias("path"), "poly_idx",
                    (q - 10).alias("x0"), (F.col("l_linenumber") * 7).cast("int").alias("y0"),
                    (q + 20).alias("x1"), (F.col("l_linenumber") * 7 + 5).cast("int").alias("y1"),
                    F.col("p_name").alias("text"))


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").alias("run"),
        F.when(F.pmod("n_regionkey", F.lit(2)) == 0, F.lit("cqa")).otherwise(F.lit("esnli")).alias("dataset"),
        F.lit("google/t5-v1_1-base").alias("from_pretrained"),
        F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.lit("task_prefix")).otherwise(F.lit("standard"))
        .alias("model_type"),
        (F.lit(8) * (F.lit(1) + F.col("n_regionkey"))).alias("batch_size"),
        (F.lit(1) + F.pmod("n_nationkey", F.lit(4))).alias("grad_steps"))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.floor(F.col("event_id") / 64).cast("bigint").alias("step"),
                    F.col("value").alias("pred_loss"), (F.col("value") / 2).alias("expl_loss"))


def asdiv_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        split_rule_2(F.col("o_orderkey")).alias("split"),
        F.col("o_orderkey").alias("row_pos"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" placed an order.")).alias("body"),
        F.lit("Which priority?").alias("question"),
        F.concat(F.pmod("o_orderkey", F.lit(90)).cast("string"), F.lit(" (items)")).alias("answer"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, text): each line of a document is one page, pages numbered from 1."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc"),
                    F.posexplode(F.split("text", NL, -1)).alias("p0", "text")) \
        .select("doc", (F.col("p0") + 1).cast("bigint").alias("page"), "text")
