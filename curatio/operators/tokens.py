"""Vocabulary, encoding, decoding and batch collation of id sequences.

The subword model of the reference is a library artefact; here a corpus vocabulary is
built by Spark (word counts, ranked) and used for encode/decode.  Ids: 0 pad, 1 end of
sequence, 2 unknown, words from 3.

Scale: the vocabulary holds every word, however many there are.  Its ``HEAD_WORDS`` most
frequent words (a fixed bound) are one hash table in which the tokens are looked up inside their
row; the other words of a row, each once, are found by a shuffle join and come back by the row
key.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio.functions.text import WORD_SPLIT_RE
from curatio.operators.positions import dense_positions, materialize

# --- fixed values -----------------------------------------------------------------------
PAD_TOKEN, EOS_TOKEN, UNK_TOKEN = "<pad>", "</s>", "<unk>"
PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
FIRST_WORD_ID = 3
LABEL_PAD_ID = -100
MAX_INPUT_LENGTH = 1024
MAX_TARGET_LENGTH = 256
# -----------------------------------------------------------------------------------------

HEAD_WORDS = 50_000     # most frequent words, broadcast; every further word is found by a shuffle join
BUCKETS = 1 << 16       # of the table of frequent words: about one word each
TASK_PREFIXES = ("predict:", "explain:")    # words with reserved ids in two-task vocabularies
SPECIALS = {PAD_TOKEN: PAD_ID, EOS_TOKEN: EOS_ID, UNK_TOKEN: UNK_ID}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Words of a text (Python ``str.split()``); special tokens are cut out even when glued.

    One regex split; the empty strings a leading or trailing space leaves are removed.
    """
    t = _c(text)
    for s in SPECIALS:
        t = F.replace(t, F.lit(s), F.lit(f" {s} "))
    return F.array_remove(F.split(t, WORD_SPLIT_RE, -1), "")


def build_vocab(texts: DataFrame, text_cols: Sequence[str], vocab_size: int | None = None,
                reserved: Sequence[str] = ()) -> DataFrame:
    """(word, id, cnt): every word, most frequent first, ties by word.

    ``reserved`` words (task prefixes, say) come before all others, whether or not the texts
    hold them.  ``vocab_size`` cuts the vocabulary if a model needs a fixed size.
    """
    if vocab_size is not None and vocab_size <= FIRST_WORD_ID + len(reserved):
        raise ValueError(f"vocab_size must exceed {FIRST_WORD_ID + len(reserved)}")
    all_tokens = F.concat(*[F.coalesce(tokens(c), F.array().cast("array<string>")) for c in text_cols])
    words = texts.select(F.explode(all_tokens).alias("word")).select("word", F.lit(1).cast("bigint").alias("n"))
    place = F.lit(len(reserved))
    for i, w in enumerate(reserved):
        place = F.when(F.col("word") == w, F.lit(i)).otherwise(place)
        words = words.unionByName(texts.sparkSession.range(1).select(F.lit(w).alias("word"), F.lit(0).cast("bigint").alias("n")))
    counts = (words.where(~F.col("word").isin(list(SPECIALS)))
              .groupBy("word").agg(F.sum("n").alias("cnt")))
    order = [F.col("cnt").desc(), F.col("word").asc()]
    ranked = dense_positions(counts, [place.asc(), *order] if reserved else order, "_rank")
    if vocab_size is not None:
        ranked = ranked.where(F.col("_rank") < vocab_size - FIRST_WORD_ID)
    return ranked.select("word", (F.col("_rank") + FIRST_WORD_ID).cast("int").alias("id"), "cnt")


def _has_key(keys: Sequence[str]) -> Column:
    """No key of the row is NULL (a row with a NULL key meets no ids or words)."""
    return functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _hash_table(entries: DataFrame) -> Column:
    """The few (_key, _value) rows of ``entries`` as one value, read once a job: ``BUCKETS`` small maps by the key's hash."""
    maps = (entries.groupBy(_bucket("_key").alias("_b")).agg(F.collect_list(F.struct("_key", "_value")).alias("_e")))
    every = entries.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("_b"))
    filled = F.sort_array(F.collect_list(F.struct("_b", "_e")))
    return every.join(F.broadcast(maps), "_b", "left").agg(filled.alias("_t")).select(
        F.transform("_t", lambda x: F.map_from_entries(x["_e"]))).scalar()


def _bucket(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _look_up(df: DataFrame, keys: Sequence[str], lists: dict[str, Column], vocab: DataFrame, key: str, value: str,
             fixed: dict | None = None) -> DataFrame:
    """Adds, per list in ``lists``, a column with the vocabulary's ``value`` for each ``key`` in the list, NULL if it has none.

    The frequent words (a fixed bound) are one hash table in which a row's whole list is looked up, so
    a row stays where it is.  Only if the vocabulary has more words do the distinct elements not found
    there travel, by a shuffle join, and come back by the row keys.
    """
    kind, result = ("string", "int") if value == "id" else ("bigint", "string")
    v = vocab.select(F.col(key).cast(kind).alias("_key"), F.col(value).cast(result).alias("_value"), "id").where("_key IS NOT NULL AND _value IS NOT NULL")
    if fixed:
        v = v.where(~F.col("_key").isin(list(fixed)))
    head = v.where(F.col("id") < FIRST_WORD_ID + HEAD_WORDS).select("_key", "_value")
    if fixed:
        pairs = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])
        head = head.unionByName(df.sparkSession.range(1).select(F.explode(pairs).alias("_key", "_value")))
    table = _hash_table(head)

    def found(words: Column, t: str) -> Column:
        both = F.array(F.struct(words.alias("words"), F.col(t).alias("t")))
        return F.get(F.transform(both, lambda p: F.transform(p["words"], lambda k: F.element_at(F.get(p["t"], _bucket(k)), k))), 0)
    # a subquery may not stand in such an expression, so the table is a column for the moment.  It is used once
    # and the exchange keeps the two projections by themselves: they are merged, and no row ever holds the table
    names = {out: f"_t{i}" for i, out in enumerate(lists)}
    df = df.repartition(*[F.col(k) for k in keys])
    df = df.select("*", *[table.alias(t) for t in names.values()]).select(*df.columns, *[found(words, names[out]).alias(out) for out, words in lists.items()])
    tail = v.where(F.col("id") >= FIRST_WORD_ID + HEAD_WORDS).select("_key", "_value")
    if tail.isEmpty():
        return df
    pairs = F.flatten(F.array(*[F.arrays_zip(words.alias("k"), F.col(out).alias("v")) for out, words in lists.items()]))
    absent = F.array_distinct(F.transform(F.filter(pairs, lambda x: x["v"].isNull()), lambda x: x["k"]))
    more = (df.select(*keys, F.explode(absent).alias("_key")).join(tail, "_key").groupBy(*keys)
            .agg(F.map_from_entries(F.collect_set(F.struct("_key", "_value"))).alias("_more")))
    df = df.join(more, list(keys), "left")
    for out, words in lists.items():
        df = df.withColumn(out, F.when(F.col("_more").isNull(), F.col(out)).otherwise(
            F.zip_with(words, out, lambda k, x: F.coalesce(x, F.element_at("_more", k)))))
    return df.drop("_more")


def _merge_repeated(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """List columns of rows that share their key put together: elements by place, then by value.

    Keys are normally unique; whether they are is counted, and only repeated ones are merged.
    """
    again = materialize(df.where(_has_key(keys)).groupBy(*keys).count().where("count > 1").select(*keys), "repeated-keys")
    if again.isEmpty():
        return df
    lists = [F.flatten(F.collect_list(F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("x"))))).alias(f"_m{n}") for n, c in enumerate(cols)]
    merged = df.join(again, list(keys), "left_semi").groupBy(*keys).agg(*lists)
    df = df.join(merged, list(keys), "left")
    for n, c in enumerate(cols):
        df = df.withColumn(c, F.when(F.col(f"_m{n}").isNull(), F.col(c)).otherwise(F.transform(F.sort_array(f"_m{n}"), lambda s: s["x"])))
    return df.drop(*[f"_m{n}" for n in range(len(cols))])


def encode(df: DataFrame, keys: Sequence[str], text_cols: dict[str, str], vocab: DataFrame,
           max_length: int, prefixes: dict[str, str] | None = None,
           masks: dict[str, str] | None = None, prepartitioned: bool = False) -> DataFrame:
    """Add one id array per ``text_cols`` entry (source column → output column).

    Each sequence is ``[prefix ids] + text ids`` cut to ``max_length - 1``, then end of
    sequence.  ``masks`` maps an id column to an attention-mask column (all ones).
    """
    prefixes = prefixes or {}
    specs = [(src, dst, max_length, prefixes.get(dst)) for src, dst in text_cols.items()]
    return encode_many(df, keys, specs, vocab, masks, prepartitioned)


def encode_many(df: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, str, int, str | None]],
                vocab: DataFrame, masks: dict[str, str] | None = None,
                prepartitioned: bool = False) -> DataFrame:
    """Several encodings in one pass: ``specs`` = (source, output, max_length, prefix or None).

    A source column is tokenised and looked up once, however many outputs use it (the
    predict and explain inputs share one body).  Tokens are looked up inside their row
    (``_look_up``): no token becomes a row of its own, unless the vocabulary has more than
    ``HEAD_WORDS`` words and it is none of the frequent ones.  The rows are dealt out by key, one
    exchange of whole rows (``prepartitioned`` doesn't spare it).
    """
    keys = list(keys)
    need: dict[str, int] = {}
    for src, _, mlen, _ in specs:
        need[src] = max(need.get(src, 0), mlen)
    srcs = list(need)
    ids = [f"_i{i}" for i in range(len(srcs))]
    empty = F.array().cast("array<string>")
    words = [F.coalesce(F.when(_has_key(keys), F.slice(tokens(src), 1, need[src] - 1)), empty) for src in srcs]
    out = _look_up(df, keys, dict(zip(ids, words, strict=True)), vocab, "word", "id", {w: i for w, i in SPECIALS.items()})
    for i in ids:
        out = out.withColumn(i, F.transform(i, lambda x: F.coalesce(x, F.lit(UNK_ID))))
    out = _merge_repeated(out, keys, ids)
    for src, dst, mlen, pre in specs:
        seq = F.col(ids[srcs.index(src)])
        if pre:
            seq = F.concat(_prefix_ids(vocab, pre), seq)
        out = out.withColumn(dst, F.concat(F.slice(seq, 1, mlen - 1), F.array(F.lit(EOS_ID))))
    for ids_col, mask_col in (masks or {}).items():
        out = out.withColumn(mask_col, F.transform(ids_col, lambda _: F.lit(1)))
    return out.drop(*ids)


def _prefix_ids(vocab: DataFrame, prefix: str) -> Column:
    """Ids of a fixed prefix text: one scalar subquery per word (a handful)."""
    from pyspark.sql.functions import array as arr

    parts = []
    for w in prefix.split():
        if w in SPECIALS:
            parts.append(F.lit(SPECIALS[w]))
        else:
            v = vocab.where(F.col("word") == w).select(F.max("id")).scalar()
            parts.append(F.coalesce(v, F.lit(UNK_ID)).cast("int"))
    return arr(*parts) if parts else F.array().cast("array<int>")


def decode(df: DataFrame, keys: Sequence[str], ids_col: str, vocab: DataFrame, out_col: str,
           prepartitioned: bool = False) -> DataFrame:
    """Ids → text, special and unknown ids skipped, words joined by a space."""
    return decode_many(df, keys, {ids_col: out_col}, vocab, prepartitioned)


def decode_many(df: DataFrame, keys: Sequence[str], cols: dict[str, str], vocab: DataFrame,
                prepartitioned: bool = False) -> DataFrame:
    """Decode several id columns (id column → text column), each id looked up inside its row."""
    keys = list(keys)
    words = [f"_w{i}" for i in range(len(cols))]
    empty = F.array().cast("array<bigint>")
    ids = [F.coalesce(F.when(_has_key(keys), F.transform(c, lambda x: F.when(x >= FIRST_WORD_ID, x).cast("bigint"))), empty) for c in cols]
    out = _look_up(df, keys, dict(zip(words, ids, strict=True)), vocab, "id", "word")
    out = _merge_repeated(out, keys, words)
    for w, text in zip(words, cols.values(), strict=True):
        # leaves out ids without a word.  ``w`` is named twice, so the lookup is a projection of its own, below any Python UDF on the text
        out = out.withColumn(text, F.when(F.size(w) > 0, F.array_join(w, " ")).otherwise(F.lit("")))
    return out.drop(*words)


def mask_predictions(ids) -> Column:
    """Negative predicted ids → pad."""
    return F.transform(_c(ids), lambda x: F.when(x >= 0, x).otherwise(F.lit(PAD_ID)))


def mask_labels(ids) -> Column:
    """Ignored label positions (−100) → pad; other negatives stay."""
    return F.transform(_c(ids), lambda x: F.when(x != LABEL_PAD_ID, x).otherwise(F.lit(PAD_ID)))


def task_unpivot(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One predict record and one explain record per row, with common column names."""
    pred = F.struct(F.lit("pred").alias("task"), F.col("input_ids").alias("input_ids"),
                    F.col("attention_mask").alias("attention_mask"), F.col("labels").alias("labels"))
    expl = F.struct(F.lit("expl").alias("task"), F.col("expl_input_ids").alias("input_ids"),
                    F.col("expl_attention_mask").alias("attention_mask"), F.col("aux_labels").alias("labels"))
    return df.select(*keys, F.explode(F.array(pred, expl)).alias("_r")).select(*keys, "_r.*")


def pad_to(ids, length, value: int) -> Column:
    c = _c(ids)
    return F.concat(c, F.array_repeat(F.lit(value), (length - F.size(c)).cast("int")))


def collate(df: DataFrame, batch_cols: Sequence[str]) -> DataFrame:
    """Pad each batch to its longest row: inputs with pad, mask with 0, labels with −100.

    The window is partitioned by the batch (bounded by the batch size), never global.
    """
    w = Window.partitionBy(*batch_cols)
    return (df.withColumn("_li", F.max(F.size("input_ids")).over(w))
            .withColumn("_ll", F.max(F.size("labels")).over(w))
            .withColumn("input_ids", pad_to("input_ids", F.col("_li"), PAD_ID))
            .withColumn("attention_mask", pad_to("attention_mask", F.col("_li"), 0))
            .withColumn("labels", pad_to("labels", F.col("_ll"), LABEL_PAD_ID))
            .drop("_li", "_ll"))


def blend_losses(df: DataFrame, alpha: float, output_rationale: bool, pred: str = "pred_loss",
                 expl: str = "expl_loss", group: Sequence[str] = ("step",)) -> DataFrame:
    """``alpha*pred + (1-alpha)*expl`` per row (expl := pred without rationale output), mean per step."""
    e = F.coalesce(F.col(expl), F.col(pred)) if output_rationale else F.col(pred)
    loss = F.lit(alpha) * F.col(pred) + F.lit(1.0 - alpha) * e
    return df.groupBy(*group).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).cast("bigint").alias("n"))


def ids_text(ids) -> Column:
    """Id array as comma-joined text (for comparisons and hashing)."""
    return F.array_join(_c(ids), ",")
