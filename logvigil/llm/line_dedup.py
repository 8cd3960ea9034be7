"""Line dedup by site-relative frequency.

A line is boilerplate of a site when the share of the site's pages that contain it exceeds a ratio.
Pages are counted once per line; a site's total counts all its pages. Lines are compared by the MD5 of
their trimmed text, so a shuffle carries 16 bytes for a line. Counting is pre-aggregated in each task,
and what comes back to a page is the list of its own boilerplate lines.

Nulls: a null text is empty and has no line, a null host is a site of its own (its rows are counted
together). Blank lines are never dropped. Repeated rows are pages of their own. An empty table gives an
empty result. Ties at the ratio stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def url_host(url: Column) -> Column:
    """Host of a URL, lower case, without port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def drop_boilerplate(pages: DataFrame, id: str = "doc_id", host: str = "source", text: str = "text",
                     ratio: float = 0.05, least_pages: int = 3) -> DataFrame:
    """``doc_id, text`` without boilerplate lines, ``n_lines`` and ``n_dropped``, one row per page.

    ``least_pages`` keeps a site of a page or two from losing everything: a line must be on that many of
    the site's pages to be dropped.
    """
    rows = pages.select(F.col(id).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "host", "text"))
    digest = lambda line: F.unhex(F.md5(F.trim(line)))
    lines = rows.select(
        "doc_id", "row_key", "host",
        F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), digest))).alias("line"),
    )
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    common = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    boilerplate = common.join(totals, "host").filter(F.col("n") > ratio * F.col("n_pages")).select("host", "line")
    per_page = lines.join(boilerplate, ["host", "line"]).groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).agg(F.collect_set("line").alias("drop"))
    joined = rows.join(per_page, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left")
    all_lines = F.split("text", "\n")
    kept = F.when(F.col("drop").isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~F.array_contains("drop", digest(x)) | (F.trim(x) == "")))
    return joined.withColumn("kept", kept).select(
        "doc_id", F.array_join("kept", "\n").alias("text"), F.size(all_lines).cast("bigint").alias("n_lines"),
        (F.size(all_lines) - F.size("kept")).cast("bigint").alias("n_dropped"),
    )


CHECK = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
 l AS (SELECT DISTINCT doc_id, host, trim(line, ' ') AS line FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line, ' ') <> ''),
 t AS (SELECT host, count(*) AS n_pages FROM d GROUP BY host),
 b AS (SELECT l.host, line FROM l JOIN t USING (host) GROUP BY l.host, line, n_pages HAVING count(*) >= 3 AND count(*) > 0.05 * n_pages),
 p AS (SELECT doc_id, host, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, host, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
 m AS (SELECT p.*, b.line IS NOT NULL AS gone FROM p LEFT JOIN b ON p.host = b.host AND trim(p.line, ' ') = b.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
 count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM m GROUP BY doc_id
"""
