"""The operators of this subpackage over their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.llm import (
    chat, decontaminate, language, mixing, neardup, negatives, neighbours, packing, quality, scoring,
    spelling, substrings, urls,
)
from freightlens.session import ship_package

# The tokenizer of the packing query, of the public files that the box offers.
TOKENIZER = "byte_bpe_50k.json"

# The rules of the URL query as (verdict, host, path).
URL_RULES = urls.UrlRules([
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
])

# Fixed value: the conversation that the chat query adds.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", "lang", language.held_out("doc_id", 5, 0).alias("held_out"))
    model = language.fit(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents"))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], rows.schema)
    return chat.digests(chat.render(rows.unionByName(extra)))


def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).drop("url")


def op8_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_documents(
        table(spark, folder, "documents"), language.held_out("doc_id", 7, 2))


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("accepted")).alias("kept"))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"), slip=True)


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", moved.alias("label"), negatives.floored(F.col("embedding"), 256).alias("embedding"))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


QUERIES = {
    "op1_language": op1_language,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_substrings": op4_substrings,
    "op5_neighbours": op5_neighbours,
    "op6_chat": op6_chat,
    "op7_urls": op7_urls,
    "op8_scoring": op8_scoring,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_negatives": op12_negatives,
    "op13_decontamination": op13_decontamination,
}
