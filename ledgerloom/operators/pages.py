"""Document text from page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages joined per task before whole documents are put together.
BLOCK = 256


def concat_pages(pages: DataFrame, keys: list[str], page_col: str, text_col: str = "text") -> DataFrame:
    """Page texts of each document joined in page order by line ends.

    Runs of pages are joined first, so the pages of a very long document are
    sorted and joined by many tasks; only its few blocks meet at the end.
    """
    def joined(order: str, text: str):
        pairs = F.array_sort(F.collect_list(F.struct(order, text)))
        return F.array_join(F.transform(pairs, lambda p: p[text]), "\n")

    blocks = (
        pages.withColumn("_block", F.floor(F.col(page_col) / BLOCK))
        .groupBy(*keys, "_block")
        .agg(joined(page_col, text_col).alias("_text"), F.count("*").alias("_pages"))
    )
    return blocks.groupBy(*keys).agg(
        joined("_block", "_text").alias("text"), F.sum("_pages").alias("pages")
    )
