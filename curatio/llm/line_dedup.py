"""Line dedup by content-defined chunks of lines, in DataFrame expressions only.

Every line is hashed; a rolling hash over ``WINDOW`` = 2 neighbouring line hashes closes a
chunk where it is divisible by ``divisor``, so chunk borders move with the lines around
them and inserting text elsewhere doesn't shift them.  A chunk of at least ``min_lines``
lines whose bytes occur more than once in the table is kept at its first occurrence (the
smallest id, then the first place in that document) and removed everywhere else.

Texts are grouped by the chunk's bytes, so equality is a byte comparison.  Occurrences are
found again by a 64-bit hash; a hash that two different chunks share removes nothing.

With ``min_words`` (the pipeline's stage; the registered query's result is fixed by its SQL)
matches are extended.  Anchors are every two neighbouring lines and every line of over
``min_words`` words; an anchor leads to its first place in the table, and a document is
compared line by line (64-bit hashes at the same distance) with the documents that its
anchors lead to.  A run of equal lines goes if it holds over ``min_words`` words, touches a
removed chunk or is the whole text.  A line only goes for an equal line at an earlier place,
so its first occurrence stays.  Line hashes of a source travel to each document that shares
an anchor with it, sources of many documents by the bounded broadcast.

Plan: one shuffle of the chunk texts (with map-side combining, so a chunk that a third of
all documents share arrives once per task), narrow joins on hashes with hot chunks
broadcast under a proven bound, and one shuffle of the documents to attach what goes.

Edge cases: NULL text stays NULL; an empty text is one empty line; a document of which every
line goes keeps an empty text and counts its removed lines; rows of equal id count as one
document (equal rows share their fate); a NULL id sorts first; an empty table gives no rows.
Columns other than the text pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import join_hot_safe, written

DIVISOR, MIN_LINES, MIN_WORDS = 3, 2, 50


def with_chunks(rows: DataFrame, text: Column, out: str, divisor: int = DIVISOR) -> DataFrame:
    """``rows`` with column ``out``: the text's chunks, each an array of lines.

    Each step is a column of its own, so that no lambda computes an array anew per element.
    """
    names = rows.columns
    rows = rows.withColumn("_lines", F.split(text, "\n"))
    rows = rows.withColumn("_hashes", F.transform("_lines", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("bigint")))
    rows = rows.withColumn("_n", F.size("_lines"))
    pairs = F.zip_with(F.concat(F.array(F.lit(0).cast("bigint")), F.slice("_hashes", 1, F.greatest(F.col("_n") - 1, F.lit(0)))),
                       F.col("_hashes"), lambda a, b: a * 31 + b)
    closing = F.transform(pairs, lambda p, i: F.when((i == F.col("_n") - 1) | (p % divisor == 0), i + 1).otherwise(F.lit(0)))
    rows = rows.withColumn("_ends", F.filter(closing, lambda e: e > 0))
    starts = F.concat(F.array(F.lit(0)), F.slice("_ends", 1, F.greatest(F.size("_ends") - 1, F.lit(0))))
    return rows.select(*names, F.zip_with(starts, F.col("_ends"), lambda s, e: F.slice("_lines", s + 1, e - s)).alias(out))


def n_words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))


def with_sources(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, tk, _src) of ``rows`` (id, tk, t): the earlier documents (or itself) that the anchors of a
    text lead to, each with its line hashes ``hs`` and the distances ``ds`` from own to source lines."""
    rows = rows.where("t IS NOT NULL").select("id", "tk", F.xxhash64("id", "tk").alias("sk"), F.split("t", "\n").alias("_l"))
    after = F.slice(F.col("_l"), 2, F.greatest(F.size("_l") - 1, F.lit(0)))
    two = F.transform(F.zip_with(F.col("_l"), after, lambda a, b: F.when((F.trim(a) != "") | (F.trim(b) != ""), F.xxhash64(a, b))),
                      lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
    one = F.transform("_l", lambda x, i: F.struct(i.alias("pos"), F.when(
        (F.length(x) > 2 * min_words) & (n_words(x) > min_words), F.xxhash64(F.lit("one line"), x)).alias("h")))
    # the last line has no next one
    found = F.concat(F.slice(two, 1, F.greatest(F.size("_l") - 1, F.lit(0))), F.filter(one, lambda x: x["h"].isNotNull()))
    anchors = rows.select("id", "tk", "sk", F.explode(found).alias("_a")).select("id", "tk", "sk", "_a.pos", "_a.h").where("h IS NOT NULL")
    repeated = written(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-anchors")
    total = int(repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    places = written(join_hot_safe(anchors, repeated, ["h"], "n", total).select("id", "tk", "sk", "pos", "h"), "anchor-places")
    first = places.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tk", "sk", "pos")).alias("f"),
                                    F.count(F.lit(1)).alias("n"))
    both = join_hot_safe(places, written(first, "first-anchors"), ["h"], "n", total)
    own = F.col("sk") == F.col("f.sk")
    both = both.where((own & (F.col("pos") > F.col("f.pos"))) | (~own & ~F.col("id").eqNullSafe(F.col("f.id"))))
    pairs = written(both.select("id", "tk", "sk", F.col("f.sk").alias("src"), (F.col("f.pos") - F.col("pos")).alias("d"))
                    .groupBy("id", "tk", "sk", "src").agg(F.collect_set("d").alias("ds")), "passage-pairs")
    uses = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    hashes = rows.select(F.col("sk").alias("src"), F.transform("_l", lambda x: F.xxhash64(x)).alias("hs"))
    sources = written(hashes.join(uses, "src").dropDuplicates(["src"]), "passage-sources")
    matched = join_hot_safe(pairs, sources, ["src"], "n", pairs.count())
    return matched.groupBy("id", "tk").agg(F.collect_list(F.struct("hs", "ds")).alias("_src"))


def without_passages(rows: DataFrame, min_words: int) -> DataFrame:
    """``_left``: the lines of ``_ls`` that stay, by ``_flags`` (removed already) and ``_src``."""
    rows = rows.withColumn("_hs", F.transform("_ls", lambda x: F.xxhash64(x))).withColumn("_ws", F.transform("_ls", n_words))
    n = F.size("_ls")

    def turns(hs: Column, d: Column) -> Column:     # where equality begins and ends, by turns
        def same(i: Column) -> Column:
            return F.coalesce(F.get("_hs", i) == F.get(hs, i + d), F.lit(False))
        return F.filter(F.sequence(F.lit(0), n), lambda i: same(i) != same(i - 1))
    rows = rows.withColumn("_turns", F.flatten(F.transform("_src", lambda x: F.transform(x["ds"], lambda d: turns(x["hs"], d)))))
    rows = rows.withColumn("_runs", F.array_distinct(F.flatten(F.transform("_turns", lambda b: F.filter(F.transform(
        b, lambda x, k: F.when(k % 2 == 0, F.struct(x.alias("s"), F.get(b, k + 1).alias("e")))), lambda r: r.isNotNull())))))

    def goes(r: Column) -> Column:
        def part(c: str) -> Column:
            return F.slice(F.col(c), r["s"] + 1, r["e"] - r["s"])
        return ((r["e"] - r["s"] == n) | F.exists(part("_flags"), lambda x: x)
                | (F.aggregate(part("_ws"), F.lit(0), lambda a, x: a + x) > min_words))
    # named twice: a column that is named once is moved into the lambda and computed anew per element
    rows = rows.withColumn("_goes", F.when(F.size("_ws") >= 0, F.filter("_runs", goes)))
    return rows.withColumn("_left", F.when(F.size("_goes") >= 0, F.filter("_ls", lambda x, i: ~(
        F.get("_flags", i) | F.exists("_goes", lambda r: (r["s"] <= i) & (i < r["e"]))))))


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR,
                           min_lines: int = MIN_LINES, removed_col: str = "lines_removed", drop_emptied: bool = False,
                           min_words: int | None = None) -> DataFrame:
    """``docs`` with repeated chunks gone from the text, and how many lines went from each row.

    ``drop_emptied``: without the rows that lost lines and have no other character than blanks left.
    ``min_words``: matches are extended by equal neighbouring lines, and runs of over so many words go.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    long_ones = F.filter(F.col("_parts"), lambda p: F.size(p) >= min_lines)
    texts = F.transform(long_ones, lambda p: F.array_join(p, "\n"))
    per_doc = with_chunks(docs.select(ident.alias("id"), text.alias("t"), F.xxhash64(text).alias("tk")), F.col("t"), "_parts", divisor)
    found = per_doc.select("id", "tk", F.explode(texts).alias("chunk")).select("id", "tk", "chunk", F.xxhash64("chunk").alias("h"))

    grouped = found.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    repeated = written(
        grouped.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.min("first").alias("first"))
        .where("kinds = 1 AND n > 1").select("h", "n", "first"), "repeated-chunks")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = per_doc.select("id", "tk", F.explode(F.array_distinct(F.transform(texts, lambda x: F.xxhash64(x)))).alias("h"))
    hits = join_hot_safe(places, repeated, ["h"], "n", int(total))
    home = F.coalesce(F.col("id") == F.col("first"), F.col("id").isNull() & F.col("first").isNull())
    marks = hits.distinct().groupBy("id", "tk").agg(
        F.collect_list(F.when(home, F.col("h"))).alias("_once"), F.collect_list(F.when(~home, F.col("h"))).alias("_never"))

    src = F.array().cast("array<struct<hs:array<bigint>,ds:array<int>>>")
    if min_words is not None:
        none = F.array().cast("array<bigint>")
        more = with_sources(per_doc.select("id", "tk", "t"), min_words).select(F.col("id").alias("id2"), F.col("tk").alias("tk2"), "_src")
        marks = marks.join(more, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tk") == F.col("tk2")), "full_outer").select(
            F.coalesce("id", "id2").alias("id"), F.coalesce("tk", "tk2").alias("tk"), F.coalesce("_once", none).alias("_once"),
            F.coalesce("_never", none).alias("_never"), F.coalesce("_src", src).alias("_src"))
    extra = ["_src"] if min_words is not None else []

    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), ident.alias("_id"), F.xxhash64(text).alias("_tk"))
    both = keyed.join(marks, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tk") == F.col("tk")), "left")
    row_text = F.col("_row")[text_col]
    marked = F.when(F.col("_once").isNotNull(), row_text)      # other rows' texts need no chunks
    both = with_chunks(both.select("_row", "_once", "_never", *extra, marked.alias("_t")), F.col("_t"), "_parts", divisor)
    both = both.withColumn("_tagged", F.transform("_parts", lambda p: F.struct(p.alias("p"), F.xxhash64(F.array_join(p, "\n")).alias("h"))))

    def stays(c: Column, i: Column) -> Column:
        earlier = F.exists(F.slice(F.col("_tagged"), 1, i), lambda x: (x["h"] == c["h"]) & (F.size(x["p"]) >= min_lines))
        return (F.size(c["p"]) < min_lines) | ~(F.array_contains("_never", c["h"]) | (F.array_contains("_once", c["h"]) & earlier))
    if min_words is not None:
        both = both.withColumn("_ls", F.flatten("_parts"))
        both = both.withColumn("_flags", F.flatten(F.transform("_tagged", lambda c, i: F.array_repeat(~stays(c, i), F.size(c["p"])))))
        both = without_passages(both, min_words)
        lines, left = F.size("_ls") - F.size("_left"), F.col("_left")
    else:
        both = both.withColumn("_kept", F.filter("_tagged", stays))
        lines = F.aggregate("_tagged", F.lit(0), lambda n, c: n + F.size(c["p"])) - F.aggregate("_kept", F.lit(0), lambda n, c: n + F.size(c["p"]))
        left = F.flatten(F.transform("_kept", lambda c: c["p"]))
    new_text = F.when(F.col("_once").isNull(), row_text).otherwise(F.array_join(left, "\n"))
    gone = F.when(F.col("_once").isNull(), F.lit(0)).otherwise(lines).cast("bigint")
    both = both.select("_row", new_text.alias("_text"), gone.alias("_gone"))
    result = F.array(F.struct("_text", "_gone"))
    if drop_emptied:
        result = F.when((F.col("_gone") > 0) & (F.trim("_text") == ""), F.slice(result, 1, 0)).otherwise(result)
    # generated, so that a filter on the result isn't moved down and computes the text again
    both = both.select("_row", F.explode(result).alias("_new"))
    return both.select(*[(F.col("_new._text") if c == text_col else F.col("_row")[c]).alias(c) for c in names if c != removed_col],
                       F.col("_new._gone").alias(removed_col))


def oracle_sql() -> str:
    """DuckDB SQL for ``doc_id, text, lines_removed`` of table ``documents`` (unique ids)."""
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
r AS (SELECT *, (coalesce(lag(h) OVER w, 0) * 31 + h) % {DIVISOR} = 0 AS closes FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CAST(closes AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
g AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, k),
m AS (SELECT *, n >= {MIN_LINES} AND row_number() OVER (PARTITION BY chunk, n >= {MIN_LINES} ORDER BY doc_id, k) > 1 AS gone FROM g),
t AS (SELECT doc_id, string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone) AS text, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS lines_removed
      FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(t.lines_removed, 0) AS lines_removed
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id"""
