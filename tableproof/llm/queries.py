"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from tableproof.llm import ann, chat_format, collocations, exact_dedup, license_scan, license_texts, mixing, near_dup, packing, runs, sharding, suffix_index, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document (grades 0 to 2), from a model fitted on the labelled ones."""
    docs, p = _read(spark, sf_dir, "documents"), toxicity.OrdinalParams()
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), p)
    rated = docs.select("doc_id", toxicity.severity(F.col("text").cast("string"), model, p).alias("s"))
    return rated.select(
        "doc_id", F.col("s")[0].alias("severity"), F.col("s")[1].alias("p_toxic"), F.col("s")[2].alias("p_severe"),
        (F.col("s")[0] >= p.reject_at).alias("rejected"),
    )


@_query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens; the other two limits never bind before that one."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op3_parity_jaccard")
def op3_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at a Jaccard similarity of 0.85 of their 4-word shingles."""
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), near_dup.Jaccard(words=4, percent=85))


@_query("op4_cross_polytope")
def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose vec_id is divisible by 50, among all others."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def domain_of_label():
    """Domain of a labelled document: good or poor prose, in short ``q1`` or ``q0``, toxic ones apart."""
    return F.when(F.col("toxic") == 1, "toxic").otherwise(F.concat(F.lit("q"), F.col("quality")))


@_query("op5_soft_mixing")
def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of every document in a mixture whose expected domain totals follow tempered shares."""
    docs = _read(spark, sf_dir, "documents")
    model = mixing.train_domains(docs, _read(spark, sf_dir, "labels"), domain_of_label())
    mixture = mixing.fit_rates(docs, model)
    return mixing.mixed(docs.select("doc_id", "text"), mixture).select("row.doc_id", "mix.*")


@_query("op6_license_digests", sql=license_scan.scan_sql())
def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document, the licence it is, and the licences its lines announce."""
    return license_scan.scan(_read(spark, sf_dir, "documents"), license_scan.known_digests(spark, license_texts.all_known()))


@_query("op7_feistel_shards")
def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = _read(spark, sf_dir, "documents").select(
        "doc_id", (F.length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.shard_rows(rows, ["doc_id"], shards=24, seed=20240607)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query("op8_chat_template", sql=chat_format.format_sql())
def op8_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, rendered and read back."""
    says = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.format_conversations(rows.unionByName(own))


@_query("op9_exact_dedup", sql="""
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ingested into a new digest index."""
    return exact_dedup.new_index(spark).ingest(_read(spark, sf_dir, "documents"))


URL_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)


@_query("op10_url_templates", sql=url_filter.judge_urls_sql(URL_RULES))
def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; a page is labelled good or bad by the label of its number."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), labels, URL_RULES)


@_query("op11_top_order_phrases", sql=collocations.top_phrases_sql(2000))
def op11_top_order_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two to four words of each language."""
    found = collocations.top_phrases(collocations.collocations(_read(spark, sf_dir, "documents")), 2000)
    return found.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@_query("op12_suffix_levels")
def op12_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that documents of smaller ids hold; two small batches and a large one."""
    done = suffix_index.without_repeats(_read(spark, sf_dir, "documents"), shares=(1, 1, 6))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@_query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, loops planted in a tenth of them by their number."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = _read(spark, sf_dir, "documents").select("doc_id", runs.looped(F.coalesce("text", F.lit("")), number).alias("text"))
    found = runs.periodic_runs(planted, keep=["doc_id"])
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    best = F.col("strongest")
    return found.select(
        "row.doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
