"""Exact dedup by skew-safe combining, in DataFrame operations only.

Equal texts are merged three times: in each task before anything is shuffled, then per digest and
salt, then over the salts. The whole text is a grouping key each time, so a shared digest alone merges
nothing. However many copies a text has, a task sends one row of it per input partition, the salts
spread those rows, and the last merge sees at most ``salts`` of them.

Nulls: a null text counts as empty, a null id is never larger than another id (all null: ``keep_id``
is null and nothing of the group is kept). Rows that repeat both the id and the text are each returned
and counted, and one of them is kept, as in ``drop_copies``. An empty table gives an empty result. Texts of any
length are compared whole.

The last look-up of a row's group goes by SHA-256 and a second hash. The merges have compared the whole texts by
then, and two groups with the same pair of hashes raise an error, so equal pairs are equal texts. That join has the
group's rows on one side and a single row on the other; where a group has a large share of all rows, Spark splits
it at run time (``spark.sql.adaptive.skewJoin.enabled``, on by default).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logvigil.llm.common import ascii_lower, texts


def _winners(body: DataFrame, salts: int) -> DataFrame:
    local = body.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = local.groupBy("digest", "check", "salt", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    texts_ = merged.groupBy("digest", "check", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).drop("body")
    one = F.count(F.lit(1)) == 1
    collision = F.raise_error(F.lit("two texts share SHA-256 and xxHash64")).cast("bigint")
    return texts_.groupBy("digest", "check").agg(F.max("keep_id").alias("keep_id"), F.when(one, F.max("group_size")).otherwise(collision).alias("group_size"))


def _bodies(docs: DataFrame) -> DataFrame:
    """Normalised text with its digest, and a second hash so that the look-up of a row's group does not rest on one."""
    return docs.withColumn("body", ascii_lower(F.col("text"))).withColumn("digest", F.unhex(F.sha2("body", 256))).withColumn("check", F.xxhash64("body"))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``; the largest id of equal texts stays."""
    ids = texts(docs, id, text)
    rows = _bodies(ids)
    found = rows.drop("text", "body").join(_winners(rows.drop("text"), salts), ["digest", "check"])
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    found = found.select(
        "doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    # Ids that several rows have, as a rule none: of equal rows with the largest id, which differ in nothing, one stays.
    several = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    equal = found.join(several, "doc_id", "left_semi").groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n"))
    blocks = equal.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n - 1) div 4096"))))
    copies = blocks.withColumn("i", F.explode(F.sequence(F.col("block") * 4096, F.least(F.col("n"), (F.col("block") + 1) * 4096) - 1)))
    once = [F.col(c) if c != "kept" else (F.col("kept") & (F.col("i") == 0)).alias("kept") for c in found.columns]
    return found.join(several, "doc_id", "left_anti").select(found.columns).union(copies.select(once))


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The documents that stay, with the columns they came with.

    A group whose ids are all null has no row to prefer and keeps one row. Whole rows are shuffled once,
    behind a merge of rows of one task that have the same id and text.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _bodies(packed)
    key = ["named", "has_id", "digest", "check"]
    named = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("named"), F.col(c).isNotNull().alias("has_id"), "digest", "check"]
    winners = _winners(rows.select("doc_id", "body", "digest", "check"), salts).select(named("keep_id"))
    return rows.select(*named("doc_id"), "_row").groupBy(*key).agg(F.first("_row").alias("_row")).join(winners, key).select("_row.*")
