"""Quality of chunks and pages as filters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.functions.chunking import chunks


def good_chunks(parts: Column | str) -> Column:
    """Array of chunks without garbage lines, without short, incomplete and low-quality ones."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    return F.filter(F.transform(parts, t.without_garbage), lambda x: (F.length(x) >= 50) & ~t.is_incomplete(x) & ~t.is_low_quality(x))


def chunked(pages: DataFrame, size: int = 600, overlap: int = 100, limit: int | None = None, embed: Callable[..., np.ndarray] | None = None, lang: Column | str | None = None) -> DataFrame:
    """A row a good chunk, numbered after filtering, of rows with text; a page's text is cut to ``limit`` first, where there is one.

    Where ``paged`` says that a row has no page, its text is a snippet, which is one chunk as it is, or none if it is empty. With ``embed`` chunks end where sentences differ.
    """
    whole = F.col("paged") if "paged" in pages.columns else F.lit(True)
    text = F.when(whole, F.col("text") if limit is None else F.col("text").substr(1, limit))
    snippet = F.when(F.col("text") != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    parts = F.when(whole, good_chunks(chunks(text, size, overlap, embed, lang))).otherwise(snippet)
    # an outer explode, as Spark finds out whether the array of a plain one is empty before that, which judges each chunk twice
    rows = pages.withColumn("_parts", parts).drop("text").select("*", F.posexplode_outer("_parts").alias("chunk_idx", "text"))
    return rows.where(F.col("chunk_idx").isNotNull()).drop("_parts")
