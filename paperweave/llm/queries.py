"""One query per operator over the whole given table, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm import sqlcheck, toxicity
from paperweave.llm import bpe, conversations, merkle, pieces
from paperweave.llm import language as lang_id
from paperweave.llm.common import lower_ascii, read, remainder
from paperweave.llm.dedup import near_duplicates
from paperweave.llm.licenses import scan_licenses
from paperweave.llm.packing import pack_documents
from paperweave.llm.quality import with_quality
from paperweave.llm.secrets import KINDS, with_secrets
from paperweave.llm.topk import top_k
from paperweave.llm.urlfilter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return put


@register("op10_quality_rules", sqlcheck.QUALITY)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the line rules for every document."""
    judged = with_quality(read(spark, sf_dir, "documents"), into="q")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    more = ["n_lines", "n_removed", "lost_chars"]
    return judged.select("doc_id", *[F.col("q")[f].alias(f) for f in fields + more])


@register("op9_license_scans", sqlcheck.LICENSES)
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places, labels and score of every document."""
    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


@register("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents of two folds out of three.

    A null id belongs to no fold: such a document is judged, not learned from.
    """
    docs = read(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 3)
    model = lang_id.train(docs.filter(fold != 1))
    judged = lang_id.with_language(docs.select("doc_id", "text"), model, into="l")
    held_out = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    return judged.select("doc_id", held_out, F.col("l")["lang"].alias("lang_pred"), F.col("l")["score"].alias("score"))


@register("op7_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, a digest of the fixed patterns' spans, and all spans."""
    found = with_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), into="s").select("doc_id", "s")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("bigint")

    base = F.filter("s", lambda x: x["kind"] != KINDS[-1])
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"),
    )


@register("op6_url_filters", sqlcheck.URLS)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    judged = judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *[F.col("url_filter")[f].alias(f) for f in ("host", "path", "rule", "verdict", "listed")])


@register("op8_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Ids of every document, and the bytes that decoding them gives back, as digests."""
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        content = file.read()
    coded = bpe.round_trip(spark, F.col("text"), content, public_tokenizers.PATTERN)
    both = read(spark, sf_dir, "documents").select("doc_id", coded.alias("c"))
    ids, decoded = F.col("c")["ids"], F.col("c")["decoded"]
    return both.select(
        "doc_id", bpe.token_numbers(ids).alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256")
    )


@register("op4_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and class of every document, learned from the labels of four folds out of five.

    A null id belongs to no fold and has no label.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = remainder(F.col("doc_id"), 5)
    labels = read(spark, sf_dir, "labels").filter(fold != 0)
    model = toxicity.train(docs, labels, toxicity.train_characters(docs))
    scored = toxicity.with_toxicity(docs, model, into="score")
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the documents with their places, the ids as a checksum."""
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        content = file.read()
    table = pack_documents(docs, content).table(ids_crc32=F.crc32("ids"))
    return table.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return packed(read(spark, sf_dir, "documents"))


@register("op2_exact_top_k", sqlcheck.TOP_K)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other rows of every hundredth vector by integer inner product."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op3_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document at three words a shingle and a similarity of 85 percent."""
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


@register("op13_sentencepiece")
def sentencepiece_round_trip(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Ids of every document with begin and end, and the text that decoding them gives back, as digests."""
    with open(model or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        content = file.read()
    both = read(spark, sf_dir, "documents").select("doc_id", pieces.round_trip(spark, F.col("text"), content).alias("c"))
    ids, decoded = F.col("c")["ids"], F.col("c")["decoded"]
    return both.select(
        "doc_id", bpe.token_numbers(ids).alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256")
    )


@register("op12_merkle_manifest", sqlcheck.MERKLE)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document, and whether its tampered form still folds to the root."""
    docs = read(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]

    def leaf(text):
        return merkle.leaf([*map(F.col, fields), text])

    tampered = F.when(remainder(F.col("doc_id"), 5) == 0, leaf(lower_ascii(F.col("text")))).otherwise(F.col("leaf"))
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text", leaf(F.col("text")).alias("leaf")).withColumn("changed", tampered)
    made = merkle.manifest(rows, F.col("source"), ["doc_id"], F.col("leaf"), carry=["doc_id", "changed"])
    root, again = F.lit(made.root), merkle.folded(merkle.as_hex(F.col("changed")), F.col("path"))
    return made.proofs.select(
        "doc_id", merkle.as_hex(F.col("leaf")).alias("leaf"), merkle.as_hex(F.col("subroot")).alias("subroot"), root.alias("root"),
        merkle.proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@register("op11_conversation_trie", sqlcheck.TRIE)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over the rebuilt conversations."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.prefix_trie(conversations.rebuilt(turns))
