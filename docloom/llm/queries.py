"""The queries opN_<name> over the whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.llm import bpe, infill, jaccard, mixing, oracles, pii, quality, secrets, sentences, suffixes, telephony, toxicity, trie, warc
from docloom.llm.store import new_dir, staged

QUERIES = {}
ORACLES = oracles.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as telephony codes, read back from the files, expanded and resampled."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.select("doc_id", "text", telephony.byte_length(F.col("text")).alias("n_bytes"))
    media = staged(telephony.store_text(docs).select("doc_id", "n_bytes", "media"), "media", compression="zstd")
    done = telephony.transcode(media, keep=("doc_id", "n_bytes", "media"))
    return done.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "codec",
        F.octet_length("pcm").cast("bigint").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )


@query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped water-filling over all sources, and the words that the mix takes of each document."""
    return mixing.mix_counts(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the blob ledger, joined back to all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan(docs, new_dir(spark, "ledger"))
    # Texts travel once, as unseen blobs; the paths go with the blobs' names only.
    paths = staged(docs.select("doc_id", secrets.blob_id(F.col("text")).alias("blob_id")), "paths")
    rows = secrets.by_path(paths, found, text=None)
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rule"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, secrets.BASE), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the line-first verdict of every document."""
    return quality.measure(documents(spark, sf_dir), cleaned=False)


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and decoded again from its ids."""
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), *how, keep=("doc_id",), back=True)
    return docs.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back in byte ranges."""
    files = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have similarity 0.8 or more."""
    return jaccard.classes(documents(spark, sf_dir))


@query
def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model spans of personal data in every document."""
    scanned = staged(pii.scan(documents(spark, sf_dir)), "pii")
    rows = pii.decode(scanned, pii.fit(scanned))
    names = F.array(*map(F.lit, pii.KINDS))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda n, kind: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("bigint").alias(f"n_{kind}")
    return rows.select("doc_id", *(count(n, k) for n, k in enumerate(pii.KINDS)), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


@query
def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated spans, the first occurrence kept."""
    done = sentences.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "removed")


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that start anywhere else."""
    done = suffixes.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at seeded code points and put into its form, with digests of the output and of the text restored from it."""
    return infill.fill_in_middle(documents(spark, sf_dir), texts=False)


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, rebuilt on common stems."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie.trie(*trie.regrown(staged(trie.numbered(conversations), "trie-numbered")))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by the compression distances of its windows, by a model of the labels that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.CUTOFF).cast("int").alias("predicted"))
