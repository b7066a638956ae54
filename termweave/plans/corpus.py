"""Corpora: (doc_id, terms, year, citations), one row per document, from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.rows import latest
from termweave.functions.text import year


def from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A document per order; its terms are the names of the parts ordered. Orders without lines have no terms."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_partkey")
    parts = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_name")
    terms = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_name")).alias("terms"))
    docs = orders.join(terms, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return docs.select(F.col("o_orderkey").alias("doc_id"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("citations"))


def from_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A document per text; its terms are the distinct words of four letters or more, in lower case; with the label lang."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "pub_year")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), F.lit(1)))
    return docs.select("doc_id", words.alias("terms"), F.col("pub_year").alias("year"), F.lit(None).cast("bigint").alias("citations"), F.coalesce("lang", F.lit("")).alias("lang"))


def from_records(spark: SparkSession, folder: str, keyword_source: str = "keywords") -> DataFrame:
    """A document per publication; its terms are its keywords as given."""
    records = latest(spark.read.parquet(f"{folder}/records.parquet").select("record_id", "loaded_at", "keywords", "keywords_plus", "pub_year", "citations"), ["record_id"], ["loaded_at"])
    return records.select(F.col("record_id").alias("doc_id"), terms_of(keyword_source).alias("terms"), year(F.col("pub_year")).try_cast("int").alias("year"), "citations")


def terms_of(keyword_source: str = "keywords"):
    """The terms of a record: keywords, keywords_plus or both; any other name means keywords."""
    none = F.array().cast("array<string>")
    own, plus = F.coalesce("keywords", none), F.coalesce("keywords_plus", none)
    return {"keywords_plus": plus, "both": F.concat(own, plus)}.get(keyword_source, own)


def domain_filter(records: DataFrame, wanted: list[str]) -> DataFrame:
    """Records that contain one of the strings, case and all, in title, abstract, keywords or keywords_plus."""
    none = F.array().cast("array<string>")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.concat_ws(" ", F.coalesce("keywords", none)), F.concat_ws(" ", F.coalesce("keywords_plus", none)))
    return records.filter(F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: text.contains(w))) if wanted else records


def coverage(corpus: DataFrame) -> DataFrame:
    """(documents, with_terms)."""
    return corpus.agg(F.count("*").alias("documents"), F.count_if(F.size("terms") > 0).alias("with_terms"))


def year_range(corpus: DataFrame) -> DataFrame:
    """(documents, with_terms, share, first_year, last_year): coverage, and the years of the documents that have one."""
    real = F.when(F.col("year") > 0, F.col("year"))
    out = corpus.agg(F.count("*").alias("documents"), F.count_if(F.size("terms") > 0).alias("with_terms"), F.min(real).alias("first_year"), F.max(real).alias("last_year"))
    return out.select("documents", "with_terms", F.try_divide("with_terms", "documents").alias("share"), "first_year", "last_year")
