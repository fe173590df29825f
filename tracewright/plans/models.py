"""Queries of the models: held-out results and explanations. They learn, so no SQL is their twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.arrow import mask_text, osa_distance, simhash_hex
from ..operators import models as M
from ..session import table


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    return M.balanced(table(spark, sf, "documents").join(labels, "doc_id").select("doc_id", "text", "label"))


def ml_text(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out confusion counts of the text model."""
    train, held = M.split(_labelled(spark, sf), "doc_id")
    return M.text_model().fit(train).transform(held).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def ml_shap(spark: SparkSession, sf: str) -> DataFrame:
    """The five features that say most about each held-out text."""
    train, held = M.split(_labelled(spark, sf), "doc_id")
    return M.linear_contributions(M.text_model(1 << 12).fit(train), train, held, "doc_id", 5)


def ml_url(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out confusion counts of the link model; the label is whether a URL carries a query."""
    c = F.col("url")
    rows = table(spark, sf, "pages").select("page_id", F.length(c).cast("double").alias("length"), F.regexp_count(c, F.lit("[0-9]")).cast("double").alias("digits"), F.regexp_count(U.host(c), F.lit("[.]")).cast("double").alias("dots"), F.length(U.path(c)).cast("double").alias("path"), (U.query(c) != "").cast("double").alias("label"))
    train, held = M.split(rows, "page_id")
    return M.url_model(["length", "digits", "dots", "path"]).fit(train).transform(held).groupBy("label", "prediction").agg(F.count("*").alias("n"))


QUERIES = {
    "ml_text": ml_text,
    "ml_shap": ml_shap,
    "ml_url": ml_url,
    "simhash": lambda s, d: table(s, d, "documents").select("doc_id", simhash_hex("text").alias("simhash")),
    "mask_text": lambda s, d: table(s, d, "documents").select("doc_id", mask_text("text").alias("masked")),
    "dl_distance": lambda s, d: table(s, d, "pages").select("page_id", U.registrable(U.host(F.col("url"))).alias("domain")).select("page_id", osa_distance("domain", F.lit("example.com")).alias("distance")),
}

ORACLE_SQL: dict[str, str] = {}
