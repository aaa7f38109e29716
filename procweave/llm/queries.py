"""Registered queries of the training-data operators (thin wrappers over whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (best_fit, chat, decontaminate, html_blocks, kneser_ney, license_scan, packing, periodic_runs, quality_rules, ranked_search,
               simhash, suffix_dedup, url_reputation)
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled page outcomes: a page's path ends in the number of the document it shows; bad if that is junk or toxic."""
    shown = pages.select("page_id", F.regexp_extract(url_reputation.url_path(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
                         .try_cast("bigint").alias("_doc")).where("_doc is not null")
    marks = labels.select(F.col("doc_id").alias("_doc"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return shown.join(marks, "_doc").select("page_id", "bad")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_reputation.filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def plant_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every document whose id's CRC-32 ends in 0 the words from one place on are repetitions."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n = F.size("_words")
    chosen = docs.select("doc_id", "text", words.alias("_words"), g.alias("_g"))
    placed = chosen.select("*", (F.col("_g") % n).cast("int").alias("_a"))
    placed = placed.select("*", (F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)) + 1).cast("int").alias("_p"))
    root = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    # the root is longer than a tenth of what it replaces, so eleven copies always suffice
    planted = F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.flatten(F.array_repeat(root, 11))), F.lit(1), n)
    return placed.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(plant_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_r"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("_r.period")
    return best.select("doc_id", "n_runs", (-F.col("_r.start")).alias("start"), F.col("_r.length").alias("length"), period.alias("period"),
                       F.expr("1000 * _r.length div -_r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_packing": op3_packing,
    "op4_chat_perspectives": op4_chat_perspectives,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filter": op7_url_filter,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_license_scan": op10_license_scan,
    "op11_ranked_search": op11_ranked_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_best_fit": op13_best_fit,
}
