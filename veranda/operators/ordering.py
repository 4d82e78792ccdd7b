"""Numbering, context, gaps and removed pages: window operators, partitioned by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reading_order(rows: DataFrame, doc: str = "doc_id", band: float = 20.0, tie: str = "index") -> DataFrame:
    """rows(doc, page_num, x, y, tie) numbered from 1 in each document: by page, band of y, x."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy("page_num", F.floor(F.col("y") / band), "x", tie)))


def inherit(rows: DataFrame, numbers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Children (parent_index set) get their parent's number."""
    n = numbers.select(doc, F.col("index").alias("__root"), "number")
    return rows.withColumn("__root", F.coalesce("parent_index", "index")).join(n, [doc, "__root"], "left").drop("__root")


def summary(annots: DataFrame) -> DataFrame:
    """Counts: total and statuses over roots, matched and unmatched over all."""
    root = F.col("parent_index").isNull()
    return annots.agg(F.count_if(root).alias("total"), F.count_if(F.col("matched")).alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"), *[F.count_if(root & (F.col("status") == s)).alias(s) for s in ("moved", "needs_look", "content_removed")])


def removed_pages(annots: DataFrame, n_old: int, n_new: int) -> DataFrame:
    """(page_num, parked): old pages that the new document lacks, and where their annotations are parked. Pages with at least half of their roots
    placed surely are anchors; where fewer new pages than old ones lie between two anchors, the weakest pages (share under 0.3) are missing."""
    good = F.col("matched") & (F.col("match_confidence") >= 0.6) & (F.col("status") == "moved")
    pages = annots.where("parent_index is null").groupBy("page_num").agg(F.avg(good.cast("double")).alias("share"), F.median(F.when(good, F.coalesce("new_page_num", "page_num"))).cast("int").alias("target"), F.min("index").alias("first"))
    spark = annots.sparkSession
    ends = spark.createDataFrame([(-1, -1), (n_old, n_new)], "page_num int, target int")
    anchors = pages.where("share >= 0.5").select("page_num", "target")
    if n_old == n_new and anchors.limit(2).count() < 2:
        return pages.limit(0).select("page_num", F.lit(0).alias("parked"))
    pts = anchors.unionByName(ends)
    w = Window.orderBy("page_num")  # a row per page of one document
    gaps = pts.select(F.col("page_num").alias("lo"), F.lead("page_num").over(w).alias("hi"), F.lead("target").over(w).alias("hi_target"), F.col("target").alias("lo_target")).withColumn("missing", (F.col("hi") - F.col("lo")) - (F.col("hi_target") - F.col("lo_target"))).where("missing > 0")
    weak = pages.where("share < 0.3").join(gaps, (F.col("page_num") > F.col("lo")) & (F.col("page_num") < F.col("hi")))
    n = F.row_number().over(Window.partitionBy("lo").orderBy("share", "first"))
    return weak.withColumn("n", n).where(F.col("n") <= F.col("missing")).select("page_num", F.greatest(F.lit(0), F.least(F.col("hi_target"), F.lit(n_new - 1))).alias("parked"))
