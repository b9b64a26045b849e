"""Mixing sources to target weights as a time-varying curriculum, in DataFrame functions only.

Each source gets a word budget in proportion to its weight, at most ``max_epochs`` times its size; what is
above is shared again among the others by weight (water filling, in closed form over the sources sorted by
the rate at which they fill). Over training time t in [0, 1] a source is drawn at the rate
budget * (1 + ramp * (2t - 1)); its integral budget * (t + ramp * (t^2 - t)) is inverted at each appearance's
word offset within its source, repeats following the first pass, which gives its training position, and appearances are range-sorted by it.

Word offsets are prefix sums in two levels: documents are ordered within a source by the MD5 of their
identifier, or where there is none of their text, whose first three hex digits name one of 4,096 buckets. Sums per (source, bucket) give each
bucket's start, a window gives the offset inside the bucket, so no task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the MD5 that name a bucket: 16 ** 3 buckets for each source.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def order_of(ident: Column, text: Column) -> Column:
    """Rows without an identifier go by their text, so that many of them do not meet in one bucket."""
    return F.md5(F.coalesce(ident.cast("string"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], ramps: tuple[float, ...], share_pct: int, max_epochs: int) -> DataFrame:
    """sizes: (_nosource, _source, source_size), a row for each source. Adds target and ramp.

    The windows here run over the table of sources, one row each, never over documents.
    """
    by_name, everything = Window.orderBy("_nosource", "_source"), Window.partitionBy()
    at = (F.row_number().over(by_name) - 1).cast("int")
    dealt = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_at") % len(values) + 1)
    s = sizes.withColumn("_at", at).withColumns({"_weight": dealt(weights).cast("long"), "ramp": dealt(ramps).cast("double")})
    s = s.withColumns({"_cap": F.col("source_size") * max_epochs, "_total": F.sum("source_size").over(everything)})
    # Sources fill up in the order of cap / weight.
    fills = Window.orderBy(F.col("_cap") / F.col("_weight"), "_at")
    before, after = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({"_filled": F.coalesce(F.sum("_cap").over(before), F.lit(0)), "_left": F.sum("_weight").over(after)})
    over = (F.col("_total") * share_pct - F.col("_filled") * 100) * F.col("_weight") > F.col("_cap") * F.col("_left") * 100
    s = s.withColumn("_full", over)
    s = s.withColumns({
        "_used": F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0)),
        "_open": F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(everything),
    })
    spare = (F.col("_total") * share_pct - F.col("_used") * 100).cast("double") / F.lit(100.0)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_weight").cast("double") * spare / F.col("_open").cast("double"))
    return s.select("_nosource", "_source", "source_size", target.alias("target"), "ramp")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    ramps: tuple[float, ...] = (0.5, -0.5, 0.0),
    share_pct: int = 150,
    max_epochs: int = 2,
    carry: bool = False,
) -> DataFrame:
    """One row per document: _id, size, source_size, target, taken, copies, position, and with ``carry`` row (a struct of all columns) and positions.

    ``taken`` counts words, repeats included; the last document of a source's budget is taken in part, so that a
    source's words add up to its target rounded down. ``copies`` is the number of appearances, an appearance of
    less than half the document counting as none. ``position`` is that of the first appearance, null if there is
    none; ``positions`` has those of all the copies. Weights and ramps are dealt to the sources in code-point order, the null source last, and repeat. A null
    or blank text has size 0 and is never taken. Rows with a null identifier are spread and ordered by their text, rows that repeat an
    identifier by their size; an empty input gives an empty result; other columns play no part.
    """
    if not (all(int(w) == w and w > 0 for w in weights) and all(-1 < r < 1 for r in ramps)):
        raise ValueError("weights are positive whole numbers, ramps lie between -1 and 1")
    key = ["_nosource", "_source", "_bucket"]
    name = F.col(source_col)
    sized = docs.select(
        F.col(id_col).alias("_id"),
        name.isNull().alias("_nosource"),
        F.coalesce(name, F.lit("")).alias("_source"),
        n_words(F.col(text_col)).alias("size"),
        order_of(F.col(id_col), F.col(text_col)).alias("_order"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    ).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))

    buckets = sized.groupBy(*key).agg(F.sum("size").alias("_sum"))
    sizes = buckets.groupBy("_nosource", "_source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, ramps, share_pct, max_epochs)
    earlier = Window.partitionBy("_nosource", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*key, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")).join(targets, ["_nosource", "_source"])

    inside = Window.partitionBy(*key).orderBy("_order", F.col("_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("_upto", F.sum("size").over(inside)).join(starts, key)
    placed = placed.withColumns({"_from": F.col("_start") + F.col("_upto") - F.col("size"), "_budget": F.floor("target")})
    part = lambda epoch: F.greatest(F.lit(0), F.least(F.col("size"), F.col("_budget") - F.col("source_size") * epoch - F.col("_from")))
    placed = placed.withColumns({f"_part{e}": part(e) for e in range(max_epochs)})
    taken = sum((F.col(f"_part{e}") for e in range(1, max_epochs)), F.col("_part0"))
    copies = sum(((F.col(f"_part{e}") * 2 >= F.col("size")).cast("int") for e in range(1, max_epochs)), (F.col("_part0") * 2 >= F.col("size")).cast("int"))

    # Cumulative demand, inverted at the middle of each appearance.
    def at(epoch: int) -> Column:
        part, a = F.col(f"_part{epoch}"), F.col("ramp")
        u = (F.col("_from") + F.col("source_size") * epoch + part / F.lit(2.0)) / F.col("_budget")
        t = F.when(a == 0, u).otherwise((F.sqrt((F.lit(1.0) - a) * (F.lit(1.0) - a) + F.lit(4.0) * a * u) - (F.lit(1.0) - a)) / (F.lit(2.0) * a))
        return F.when(part > 0, F.floor(t * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6))

    every = F.filter(F.array(*[F.when(F.col(f"_part{e}") * 2 >= F.col("size"), at(e)) for e in range(max_epochs)]), lambda p: p.isNotNull())
    placed = placed.select(
        "_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"),
        at(0).alias("position"),
        *([F.col("row"), every.alias("positions")] if carry else []),
    )
    if carry:
        return placed  # its order is that of the appearances
    return placed.repartitionByRange(F.col("position").asc_nulls_last(), F.xxhash64("_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "_id")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it appears, in training order, with docs' columns: every appearance has a position of its own.

    Null and blank texts have no words and are left out; repeated rows are documents of their own. An empty input gives an empty result.
    """
    out = mix(docs, carry=True, **how).select("row", "_id", F.posexplode("positions").alias("_epoch", "_at"))
    return out.repartitionByRange("_at", F.xxhash64("_id", "_epoch")).sortWithinPartitions("_at", "_id", "_epoch").select("row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).withColumnRenamed("_id", "doc_id").drop("copies")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS nosource, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS ord
  FROM documents
), s AS (
  SELECT nosource, src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY nosource, src) - 1 AS k FROM d GROUP BY 1, 2
), w AS (
  SELECT *, ([3, 1, 2])[(k % 3) + 1]::BIGINT AS weight, ([0.5, -0.5, 0.0])[(k % 3) + 1]::DOUBLE AS ramp,
         2 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s
), f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
         (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lft FROM w
), g AS (
  SELECT *, (total * 150 - filled * 100) * weight > cap * lft * 100 AS is_full FROM f
), h AS (
  SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0)::BIGINT AS used, (sum(weight) FILTER (NOT is_full) OVER ())::BIGINT AS opn FROM g
), t AS (
  SELECT nosource, src, source_size, ramp,
         CASE WHEN is_full THEN cap::DOUBLE ELSE weight::DOUBLE * ((total * 150 - used * 100)::DOUBLE / 1e2) / opn::DOUBLE END AS target FROM h
), p AS (
  SELECT d.*, t.source_size, t.target, t.ramp, floor(t.target)::BIGINT AS budget,
         (sum(d.size) OVER (PARTITION BY nosource, src ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS frm
  FROM d JOIN t USING (nosource, src)
), q AS (
  SELECT *, greatest(0, least(size, budget - frm)) AS p0, greatest(0, least(size, budget - source_size - frm)) AS p1 FROM p
), r AS (
  SELECT *, CASE WHEN p0 > 0 THEN (frm + p0 / 2e0) / budget END AS u FROM q
)
SELECT doc_id, size, source_size, target, (p0 + p1)::BIGINT AS taken,
       floor((CASE WHEN ramp = 0 THEN u ELSE (sqrt((1e0 - ramp) * (1e0 - ramp) + 4e0 * ramp * u) - (1e0 - ramp)) / (2e0 * ramp) END) * 1e6 + 0.5e0) / 1e6 AS position
FROM r
"""
