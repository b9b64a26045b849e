"""Exact deduplication by a distributed content sort, in DataFrame functions only.

Rows are range-partitioned on the first 32 normalised characters by Spark's sampled splitters, sorted within partitions
on the whole normalised text, and every row is compared in full with its predecessor; runs of equal texts are the groups.
The splitter key is bounded, so sampling never brings whole texts to the driver.

Beginnings that many texts share would fill one partition. A beginning of more than 1/HOT of all rows is cut into slices
by a hash of the text, so different texts part and equal ones stay together; a slice that is large all the same holds a
large group of copies, and its rows are dealt to salts. The first row of each salted run then goes through a second content
sort, a slice's salts in lots and then the lots, where these heads are again compared in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.common import ascii_lower, rereadable, written

#: Beginnings and slices above 1/HOT of the rows are cut up; there cannot be more of them than this, which bounds what is broadcast.
HOT = 20_000
#: Nothing of fewer rows is cut up.
LEAST_HOT = 100
PREFIX_CHARS = 32
#: Salts of a slice whose heads are compared at once.
LOT = 128

GROUP = ["_prefix", "_slice", "_salt"]


def _runs(rows: DataFrame, keys: list[str], order, size) -> DataFrame:
    """Adds _first, _run, _best (a struct) and _size: rows of one key in the order of _norm and then of order, runs of equal _norm, the run's first row, and its summed size."""
    content = Window.partitionBy(*keys).orderBy("_norm", *order)
    upto = content.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_first", ~F.col("_norm").eqNullSafe(F.lag("_norm").over(content)))
    rows = rows.withColumns({"_run": F.sum(F.col("_first").cast("long")).over(upto), "_best": F.last(F.when(F.col("_first"), F.struct("_id")), True).over(upto)})
    return rows.withColumn("_size", F.sum(size).over(Window.partitionBy(*keys, "_run")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: bool = True) -> DataFrame:
    """One row per input row: row (struct of all input columns but the text), text, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z. ``keep`` names the identifier that stays,
    "smallest" or "largest". A null text equals the empty one. Null identifiers sort last: such a row stays only
    where its group has no other. Of rows that repeat identifier and text exactly one stays. An empty input gives
    an empty result; other columns, whatever their names, travel in ``row``. Without ``carry`` there is no text in the result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    docs = rereadable(docs, "texts")  # salts are dealt by place
    limit = max(LEAST_HOT, -(-docs.count() // HOT))
    text, pieces = F.coalesce(F.col(text_col), F.lit("")), F.ceil(F.col("count") / F.lit(limit)).cast("int")
    prefix = ascii_lower(F.substring(text, 1, PREFIX_CHARS))

    common = docs.groupBy(prefix.alias("_prefix")).count().where(F.col("count") > limit).select("_prefix", pieces.alias("_slices"))
    slice_ = F.when(F.col("_slices").isNull(), 0).otherwise(F.pmod(F.xxhash64(ascii_lower(F.col("_text"))), F.col("_slices"))).cast("int").alias("_slice")
    begun = docs.select(prefix.alias("_prefix"), text.alias("_text")).join(F.broadcast(common), "_prefix")
    large = begun.select("_prefix", slice_).groupBy("_prefix", "_slice").count().where(F.col("count") > 2 * limit).select("_prefix", "_slice", pieces.alias("_salts"))

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, id_col)]
    rows = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.col(text_col).isNull().alias("_null"), F.struct(F.col(id_col), *rest).alias("row"),
        prefix.alias("_prefix"), F.monotonically_increasing_id().alias("_place"),
    )
    rows = rows.join(F.broadcast(common), "_prefix", "left").select(*rows.columns, slice_).join(F.broadcast(large), ["_prefix", "_slice"], "left")
    rows = rows.withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.col("_place") % F.col("_salts")).otherwise(0).cast("int")).drop("_place")

    # The sampled splitters and the external sort; equal texts end up side by side.
    order = [F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()]
    rows = _runs(rows.repartitionByRange(*GROUP).withColumn("_norm", ascii_lower(F.col("_text"))), GROUP, order, F.lit(1))
    hot = F.col("_salts").isNotNull()
    rows = rows.withColumns({"_sha": F.sha2("_norm", 256), "_head": F.when(hot & F.col("_first"), F.col("_norm"))}).drop("_norm", *([] if carry else ["_text"]))
    rows = written(rows, "exact")

    # Heads of salted runs: a slice's salts in lots, then what is left of the lots. Each keeps the number of its run.
    heads = rows.where(hot & F.col("_first")).select(*GROUP, "_run", F.col("_head").alias("_norm"), F.col("_best._id").alias("_id"), "_size")
    heads = heads.withColumns({"_lot": F.floor(F.col("_salt") / LOT).cast("int"), "_of": F.struct("_salt", "_run")}).withColumnRenamed("_size", "_n").drop("_run")
    lots = written(_runs(heads, ["_prefix", "_slice", "_lot"], order, F.col("_n")), "heads")
    tops = lots.where("_first").select("_prefix", "_slice", "_lot", F.col("_run").alias("_lot_run"), "_norm", F.col("_best._id").alias("_id"), F.col("_size").alias("_n"))
    tops = _runs(tops, ["_prefix", "_slice"], order, F.col("_n")).select("_prefix", "_slice", "_lot", F.col("_lot_run").alias("_run"), F.col("_first").alias("_top"), F.col("_best").alias("_all_best"), F.col("_size").alias("_all_size"))
    whole = lots.join(tops, ["_prefix", "_slice", "_lot", "_run"])
    whole = whole.select("_prefix", "_slice", F.col("_of._salt").alias("_salt"), F.col("_of._run").alias("_run"), (F.col("_first") & F.col("_top")).alias("_wins"), "_all_best", "_all_size")

    # In a run the first row is the best one, and so is the first of all heads.
    cold = rows.where(~hot).withColumns({"_wins": F.lit(True), "_all_best": F.col("_best"), "_all_size": F.col("_size")})
    rows = cold.unionByName(rows.where(hot).join(whole, [*GROUP, "_run"]))
    return rows.select(
        "row",
        *([F.when(~F.col("_null"), F.col("_text")).alias("text")] if carry else []),
        F.col("_all_best._id").alias("keep_id"),
        F.col("_all_size").alias("group_size"),
        (F.col("_first") & F.col("_wins")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    groups = exact_groups(docs, id_col, text_col, keep).where("kept")
    return groups.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs, keep="largest", carry=False).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
