"""Text from the boxes of recognised words: lines and columns of a page, as windows over its boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Centres further apart than this share of the usual height of a page's boxes are different lines; a gap wider than
#: this many heights separates columns.
LINE, COLUMN = 0.6, 1.5


def page_texts(boxes: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``text``, ``ocr_conf`` from ``doc_id``, ``page``, ``x0``, ``y0``, ``x1``, ``y1``, ``text``, ``conf``.

    A page's boxes are swept from top to bottom into lines and each line from left to right; wide gaps become `` | ``.
    Empty boxes and boxes without a place are left out; the confidence is the mean by letters.
    """
    page = ["doc_id", "page"]
    b = boxes.withColumn("text", F.trim("text")).where((F.col("text") != "") & F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull())
    usual = b.groupBy(*page).agg(F.percentile_approx(F.abs(F.col("y1") - F.col("y0")), 0.5).alias("h"))
    b = b.join(usual, page).withColumn("yc", (F.col("y0") + F.col("y1")) / 2)
    down = Window.partitionBy(*page).orderBy("yc", "x0", "text")
    starts = F.coalesce(F.col("yc") - F.lag("yc").over(down) > LINE * F.col("h"), F.lit(True))
    b = b.withColumn("line", F.sum(starts.cast("int")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    along = Window.partitionBy(*page, "line").orderBy("x0", "yc", "text")
    reach = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(reach.isNull(), "").when(F.col("x0") - reach > COLUMN * F.col("h"), " | ").otherwise(" ")
    b = b.withColumn("said", F.concat(gap, "text")).withColumn("nth", F.row_number().over(along))
    size = F.length("text")
    lines = b.groupBy(*page, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "said"))), lambda x: x["said"]), "").alias("said"), F.sum(F.when(F.col("conf").isNotNull(), F.col("conf") * size)).alias("c"), F.sum(F.when(F.col("conf").isNotNull(), size)).alias("n"))
    return lines.groupBy(*page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n").alias("text"), F.round(F.sum("c") / F.sum("n"), 6).alias("ocr_conf"))
