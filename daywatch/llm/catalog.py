"""The registered queries of the operators and, where SQL can say the same, their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywatch.llm import bpe, exact, licenses, lm, manifest, packing, quality, simhash, substring, url_filters, warc, whitening
from daywatch.llm import check_sql as sql
from daywatch.llm import lines as line_dedup
from daywatch.llm.text import ascii_lower
from daywatch.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

#: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Ends every document in a packed sequence.
END_ID = 2


def word_vocabulary() -> str:
    """The vocabulary file of the packing queries, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def rank_file() -> str:
    """The rank file of the byte-level queries, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_filters", sql.url_filters(URL_RULES))
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


@query("op3_license_scan", sql.license_scan(licenses.KNOWN, licenses.SPELLINGS, licenses.KNOWN_DIGESTS, licenses.PROSE))
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents, or lines of them, are."""
    known, more = licenses.known_licences(spark), licenses.known_digests(spark)
    return licenses.scan(table(spark, sf_dir, "documents"), known, more=more)


@query("op4_exact_dedup", sql.EXACT_DEDUP)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in two bits or fewer."""
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query("op7_quality_rules", sql.quality_rules())
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judge(docs)
    q = F.col("quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[q[n].alias(n) for n in names])


@query("op2_substring_dedup", sql.SUBSTRING_DEDUP)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the passages that an earlier one has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = F.col("parsed")
    return substring.parsed(docs).select(
        "doc_id", p["n_words"].alias("n_words"), p["n_removed"].alias("n_removed"),
        F.sha2(p["kept_text"], 256).alias("kept_sha256"),
    )


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), word_vocabulary(), END_ID)


@query("op9_warc_round_trip", sql.WARC)
def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    manifest = warc.write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    read = warc.read(manifest, keep_payload=False)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return read.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"), "digest_ok",
    )


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    ranks = rank_file()
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks).drop("text")
    return bpe.decode(coded, ranks).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_lm_score")
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.train(docs), keep_text=False)


@query("op11_line_dedup", sql.LINE_DEDUP)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the lines that later ones repeat."""
    rows = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.col("lines")
    return rows.select(
        "doc_id", x["n_lines"].alias("n_lines"), x["n_dropped"].alias("n_dropped"),
        F.sha2(x["kept_text"], 256).alias("kept_sha256"),
    )


@query("op12_merkle_manifest", sql.merkle_manifest())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document; a fifth of them show a text in lower case."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    shown = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in fields]
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, manifest.leaf(shown))
    return manifest.manifest(docs, fields, claim=claim)


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading components of every vector, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
