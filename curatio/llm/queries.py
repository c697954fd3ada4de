"""The registered query of each operator: thin, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatio.llm import ann, fingerprints, langid, line_dedup, merkle, mixing, order_minhash, packing, partenum, pii, prefix_trie, token_files, toxicity
from curatio.llm.common import held_out, read_table, written
from curatio.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


# Domains of the labelled table, and the share of tokens each is to have.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'clean' WHEN quality = 0 THEN 'low' END"
MIX_WEIGHTS = {"clean": 0.86, "low": 0.10, "toxic": 0.04}


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of every document for the target mix."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), F.expr(DOMAIN), MIX_WEIGHTS)
    return mixed.select(F.col("id").alias("doc_id"), F.col("tokens").cast("bigint").alias("n_tokens"),
                        *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(MIX_WEIGHTS)], "rate", "copies")


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written and read back; the digest of each document's ids."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, end_id=1)
    return token_files.read_sequences(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return langid.predict(rows, model, keep=["doc_id", "held_out"])


@_query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likenesses."""
    return fingerprints.compare_with_next(read_table(spark, sf_dir, "documents"))


@_query
def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the patterns' spans, and all spans."""
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: ~x["added"])
    counts = [F.expr(f"bigint(size(filter(spans, x -> NOT x.added AND x.kind = '{k}')))").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda x: x["added"])).cast("bigint").alias("n_added"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return (toxicity.score(rows, model, keep=["doc_id", "held_out"])
            .withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0)))


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the line chunks that occur earlier in the table."""
    return line_dedup.remove_repeated_chunks(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


ORACLE["op9_line_dedup"] = line_dedup.oracle_sql()


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens; one row per piece."""
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "loss_tokens")


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document against the dataset's root."""
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if i == 3 else c for i, c in enumerate(fields)]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_digest(changed))
    leaves = docs.select(merkle.tree_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("bigint").alias("id"),
                         merkle.leaf_digest(fields).alias("digest"), F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), tampered.alias("tampered")).alias("load"))
    folded = merkle.fold(F.coalesce("load.tampered", "digest"), F.col("path"))
    return merkle.proofs(leaves).select(
        "load.doc_id", F.col("digest").alias("leaf"), "facts.subroot", "facts.root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie over the conversations, rebuilt with the heads they share."""
    own = written(prefix_trie.conversations(read_table(spark, sf_dir, "conversations")), "own-turns")
    heads = own.where("conv_id % 100 = 0").selectExpr("conv_id AS head_id", "slice(seq, 1, 5) AS head")
    both = own.selectExpr("*", "int(crc32(string(conv_id)) % 6) AS h", "conv_id - conv_id % 100 AS head_id").join(heads, "head_id", "left")
    rebuilt = both.selectExpr("conv_id", "concat(slice(coalesce(head, slice(seq, 1, 0)), 1, h), slice(seq, h + 1, size(seq))) AS seq")
    return prefix_trie.trie_nodes(rebuilt).withColumnRenamed("ends", "ends_sha256")


@_query
def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document under the exact 0.8 Jaccard link."""
    return partenum.linked_classes(read_table(spark, sf_dir, "documents"))


ORACLE["op11_shingle_join"] = partenum.oracle_sql()
ORACLE["op12_prefix_trie"] = prefix_trie.oracle_sql()
ORACLE["op13_merkle_manifest"] = merkle.oracle_sql()
