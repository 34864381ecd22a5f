"""Line removal by how many of a site's pages have the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.quality import has_word
from tidepool.llm.store import with_text, written

MAX_RATIO = 0.1
MIN_PAGES = 10


def _hash(line: Column) -> Column:
    """A line's 128-bit fingerprint; spaces around it don't count."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7919), line).alias("b"))


def _with_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), has_word)


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, lines``: fingerprints of lines on more than ``max_ratio`` of a host's pages and on ``min_pages`` at least.

    A page counts once for a line, however often it has it. Both counts are map-side combined, so neither a
    hot host nor a hot line gathers in one task. A host's list holds at most the mean number of lines on
    a page over ``max_ratio``, however large the host is.
    """
    totals = docs.groupBy(_host(host).alias("host")).agg(F.count(F.lit(1)).alias("total"))
    lines = F.array_distinct(F.transform(_with_word(F.col("text")), F.trim))  # strings are told apart by a hash set, structs pair by pair
    lines = docs.select(_host(host).alias("host"), F.explode(F.transform(lines, _hash)).alias("line"))
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    found = counted.join(totals, "host").where(F.col("n") > F.col("total") * max_ratio)
    return found.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` (long) and, in ``text``, without boilerplate lines; all rows and columns stay.

    Columns of ``docs`` that have these two names are replaced; ``n_chars`` follows the text, if there is
    such a column. ``n_lines`` counts lines with a word; lines without one are always kept. A null text stays
    null and has no lines; null hosts count as one host; repeated rows are pages of their own.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    found = written(boilerplate(docs, host, max_ratio, min_pages), "boilerplate")
    rows = docs.select(F.struct("*").alias("_doc"), _host(host).alias("_host")).join(found.select(F.col("host").alias("_host"), F.col("lines").alias("_gone")), "_host", "left")
    text = F.col("_doc.text")
    left = F.filter(F.split(text, "\n"), lambda x: ~(F.array_contains("_gone", _hash(x)) & has_word(x)))
    rows = rows.select("_doc", F.when(F.col("_gone").isNotNull(), left).alias("_left"), F.coalesce(F.size(_with_word(text)), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_dropped", F.coalesce(F.size(F.split(text, "\n")) - F.size("_left"), F.lit(0)).cast("long"))
    rows = rows.withColumn("_text", F.when(F.col("n_dropped") > 0, F.array_join("_left", "\n")).otherwise(text))
    return with_text(rows, names, "n_lines", "n_dropped")
