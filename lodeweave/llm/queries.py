"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import boilerplate, encoding, leakage, neardup, packing, prose, scans, templates
from .common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.find_residue(table(spark, sf_dir, "extract_result")).select("extract_id").distinct()


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each kind of residue and each mined template accounts for."""
    found = templates.find_residue(table(spark, sf_dir, "extract_result"))
    return found.groupBy("field_name", "kind", "template").agg(F.countDistinct("extract_id").alias("records"))


LEAST_WORDS = {"content": 50, "description": 20}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = table(spark, sf_dir, "extract_result").select(F.lit("content").alias("field_name"), F.col("extract_id").alias("id"), F.col("content").alias("text"))
    description = table(spark, sf_dir, "search_hit").select(F.lit("description").alias("field_name"), F.col("hit_id").alias("id"), F.col("description").alias("text"))
    return content.unionByName(description).where("id is not null and trim(text) != ''")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(_texts(spark, sf_dir), LEAST_WORDS)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every text of any length among five-word shingles at a similarity of 0.8, and its number of links."""
    return neardup.near_duplicate_groups(_texts(spark, sf_dir), dict.fromkeys(LEAST_WORDS, 0), shingle=5, threshold=0.8)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(table(spark, sf_dir, "extract_result")).select("extract_id", "field_name").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrongly decoded values with the original text, and whether all of it came back."""
    return encoding.find_garbled(table(spark, sf_dir, "extract_result")).distinct()


def _site() -> Column:
    return F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1).alias("site")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables of pages, without the records of problem 1."""
    extracts = table(spark, sf_dir, "extract_result").select(F.lit("extract_result").alias("table_name"), F.col("extract_id").alias("row_id"), "title", F.col("content").alias("text"), F.lit(None).cast("string").alias("html"), _site())
    articles = table(spark, sf_dir, "readability_output").select(F.lit("readability_output").alias("table_name"), F.col("article_id").alias("row_id"), "title", F.col("text_content").alias("text"), F.col("content").alias("html"), _site())
    return extracts.unionByName(articles)


def _without_residue(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    residue = p1_found(spark, sf_dir).select(F.lit("extract_result").alias("table_name"), F.col("extract_id").alias("row_id"))
    return rows.join(residue, ["table_name", "row_id"], "left_anti")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return _without_residue(spark, sf_dir, boilerplate.furniture_lines(pages, boilerplate.fit(pages))).distinct()


def p4_main_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return _without_residue(spark, sf_dir, boilerplate.main_bodies(pages, boilerplate.fit(pages))).dropDuplicates(["table_name", "row_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.Scans(table(spark, sf_dir, "pdf_extract_result")).noise().select("pdf_id", "line_no", "noise").distinct()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every document."""
    return scans.Scans(table(spark, sf_dir, "pdf_extract_result")).repaired()


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text or piece, for every capacity."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "packing_target"))


def p6_unused_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.filling(p6_containers(spark, sf_dir), table(spark, sf_dir, "packing_target"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return spans.select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word ranges to be cut out of each document."""
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.text_statistics(table(spark, sf_dir, "documents")).where("not is_prose").select("doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.text_statistics(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kinds, p2_found, p2_groups, p3_found, p3_restored, p4_found, p4_main_body, p5_found, p5_repaired, p6_containers, p6_unused_space, p7_found, p7_spans, p8_found, p8_statistics)}
ORACLES: dict[str, str] = {}
