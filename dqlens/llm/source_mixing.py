"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources, in code-point order with null last, weigh 3, 1, 2
repeating and share ``share`` times all words.  A source's target stops at
``max_epochs`` times its own size; what it cannot take is shared out again by
weight until no source is above its stop (water filling, solved in closed
form over the table of sources).

Selection: a source first gives every document ``floor(target / size)``
times.  The remaining budget is filled by weighted sampling without
replacement: every document gets the exponential key ``-ln(u) / quality``
(``u`` from a hash of its id, so reruns agree), documents are taken in
ascending key order while their prefix sum fits, and up to ``CLOSING`` more
documents, each the one whose size comes nearest to the rest, close the gap.

Scale: only narrow rows (id, source, size, key) are stored and summed; texts
never move.  No source is sorted as a whole: keys fall into about
sqrt(documents) buckets per source, bucket sums are pre-aggregated, and only
the bucket in which a budget ends is sorted.  A source with a third of all
rows thus costs one task about sqrt(rows) rows.  DataFrame functions only.

Defined cases: a null source is a source of its own; a null text has size 0;
documents of size 0 take nothing; an empty table gives an empty result; rows
that repeat an id of the same source share key and decision; a null id is
hashed as the empty string.  Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqlens.llm.common import free_name, stored, word_count

#: weights of the sources in code-point order, repeating
SOURCE_WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: documents that may close the gap which the prefix sum leaves
CLOSING = 3


def quality_weight(text: Column) -> Column:
    """Native quality weight in [0.2, 1]: falls with the share of symbol characters."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0))
    length = F.greatest(F.coalesce(F.char_length(text), F.lit(0)), F.lit(1))
    return F.greatest(F.lit(0.2), F.lit(1.0) - symbols * F.lit(4.0) / length)


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """Exponential key -ln(u) / weight; u in (0, 1) from 48 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2 ** 48))) / weight


def measured(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> list[Column]:
    text = F.col(text_col)
    return [F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
            word_count(text).alias("_size"),
            sampling_key(F.col(id_col), quality_weight(text), seed).alias("_key"),
            quality_weight(text).alias("_quality")]


def source_targets(sizes: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
                   weights: tuple = SOURCE_WEIGHTS) -> DataFrame:
    """Target of every source from a table of (source, source_size).

    With r = stop / weight in ascending order, the level that a source would
    get if all before it stand at their stops is (total - stops before) /
    (weight left).  It rises while stops bind and falls afterwards, so its
    maximum is the common level; each target is min(stop, weight * level).
    The windows run over the table of sources, one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("stop", F.col("source_size") * F.lit(float(max_epochs)))
    ranked = ranked.withColumn("ratio", F.col("stop") / F.col("w"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = (Window.orderBy("ratio", F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    levels = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share))
         - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    levels = levels.withColumn("level", F.max("level").over(everything))
    return levels.withColumn("target", F.least("stop", F.col("w") * F.col("level"))).select(
        "source", "source_size", "n_docs", "mean_quality", "target")


def thresholds(rows: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Per source: size, target, epochs, and up to which (key, id) the
    fractional selection goes; ``extras`` names the closing documents."""
    sizes = rows.groupBy(F.col("_source").alias("source")).agg(
        F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"),
        F.avg("_quality").alias("mean_quality"))
    plan = source_targets(sizes, share, max_epochs)
    plan = plan.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("n_buckets", F.ceil(F.sqrt(F.col("n_docs"))).cast("long"))
    plan = stored(plan, "mix-plan")

    # bucket of a key: its quantile under an exponential law of the mean rate
    keyed = rows.join(plan, rows["_source"].eqNullSafe(plan["source"])).select(
        "_id", "_source", "_size", "_key", "budget",
        F.floor((F.lit(1.0) - F.exp(-F.col("_key") * F.col("mean_quality"))) * F.col("n_buckets"))
        .alias("bucket"))
    sums = keyed.groupBy("_source", "bucket", "budget").agg(F.sum("_size").alias("bucket_size"))
    upto = Window.partitionBy("_source").orderBy("bucket")
    sums = sums.withColumn("prior", F.sum("bucket_size").over(upto) - F.col("bucket_size"))
    # the first bucket that does not fit whole
    ends = (sums.where(F.col("prior") + F.col("bucket_size") > F.col("budget"))
            .groupBy("_source").agg(F.min(F.struct("bucket", "prior")).alias("end"))
            .select(F.col("_source").alias("end_source"), "end.bucket", "end.prior"))
    ends = ends.withColumnRenamed("bucket", "end_bucket")
    inside = keyed.join(ends, keyed["_source"].eqNullSafe(ends["end_source"])
                        & (keyed["bucket"] == ends["end_bucket"]))
    order = Window.partitionBy("_source").orderBy("_key", F.col("_id").asc_nulls_first())
    inside = inside.withColumn("through", F.col("prior") + F.sum("_size").over(
        order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    cuts = inside.groupBy("_source").agg(
        F.min(F.when(F.col("through") > F.col("budget"),
                     F.struct("_key", F.col("_id").alias("cut_id"),
                              (F.col("budget") - F.col("through")).alias("over")))).alias("cut"),
        F.max(F.when(F.col("through") <= F.col("budget"), F.col("through"))).alias("fits"),
        F.first("prior").alias("prior"))
    cuts = cuts.select(F.col("_source").alias("cut_source"), F.col("cut._key").alias("cut_key"),
                       F.col("cut.cut_id").alias("cut_id"),
                       F.coalesce("fits", "prior").alias("fits"))
    plan = plan.join(cuts, plan["source"].eqNullSafe(cuts["cut_source"]), "left").drop("cut_source")
    plan = stored(plan.withColumn("rest", F.col("budget") - F.col("fits")), "mix-cuts")

    plan = plan.withColumn("extras", F.array().cast(
        rows.select(F.array(F.struct("_key", "_id"))).schema[0].dataType))
    for _ in range(CLOSING):
        plan = stored(_close(rows, plan), "mix-thresholds")
    return plan


def _close(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to each source's ``extras`` the document, of those not taken yet,
    whose size comes nearest to the rest, if it brings the sum nearer."""
    later = rows.join(plan.where("cut_key IS NOT NULL AND rest > 0"),
                      rows["_source"].eqNullSafe(F.col("source")) & ~_fraction())
    gap = F.abs(F.col("_size") - F.col("rest"))
    closing = (later.where((F.col("_size") > 0) & (gap < F.col("rest")))
               .groupBy("_source").agg(F.min(F.struct(gap.alias("gap"), "_key", "_id", "_size")).alias("x"))
               .select(F.col("_source").alias("x_source"), F.struct("x._key", "x._id").alias("x"),
                       F.col("x._size").alias("x_size")))
    plan = plan.join(closing, plan["source"].eqNullSafe(closing["x_source"]), "left")
    return plan.withColumn("rest", F.col("rest") - F.coalesce("x_size", F.lit(0))).withColumn(
        "extras", F.when(F.col("x").isNull(), F.col("extras"))
        .otherwise(F.concat("extras", F.array("x")))).drop("x_source", "x", "x_size")


def selected_expr() -> Column:
    """Whether a measured row lies before its source's cut."""
    key, cut = F.col("_key"), F.col("cut_key")
    before_id = F.coalesce(F.col("_id") < F.col("cut_id"),
                           F.col("_id").isNull() & F.col("cut_id").isNotNull())
    return cut.isNull() | (key < cut) | ((key == cut) & before_id)


def _fraction() -> Column:
    """Whether a measured row is in its source's fractional selection."""
    chosen = F.exists("extras", lambda x: (x["_key"] == F.col("_key")) & x["_id"].eqNullSafe(F.col("_id")))
    return (F.col("budget") > 0) & (selected_expr() | chosen)


def _copies() -> Column:
    return F.col("epochs") + F.when(_fraction(), F.lit(1)).otherwise(F.lit(0))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", share: float = SHARE, max_epochs: float = MAX_EPOCHS,
                seed: str = "mix") -> DataFrame:
    """Decision of every document: id, source, size, source_size, target,
    copies (times it is taken whole) and taken (= copies * size)."""
    rows = stored(docs.select(*measured(docs, id_col, source_col, text_col, seed)), "mix-rows")
    plan = thresholds(rows, share, max_epochs)
    joined = rows.join(plan, rows["_source"].eqNullSafe(plan["source"]))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"),
        "source_size", "target", _copies().alias("copies"),
        (_copies() * F.col("_size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
              text_col: str = "text", share: float = SHARE, max_epochs: float = MAX_EPOCHS,
              seed: str = "mix") -> DataFrame:
    """The mixed table itself: every row of ``docs``, with all its columns,
    as often as it is taken.  The cuts (one row per source) meet the texts
    where they are read; no text is shuffled."""
    cols = docs.columns
    row = free_name(docs, "row")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias(row),
                        *measured(docs, id_col, source_col, text_col, seed))
    rows = stored(inner.drop(row), "mix-rows")
    plan = thresholds(rows, share, max_epochs)
    joined = inner.join(plan, inner["_source"].eqNullSafe(plan["source"]))
    taken = joined.select(row, _copies().alias("_n")).where("_n > 0")
    return taken.select(F.explode(F.array_repeat(row, F.col("_n").cast("int"))).alias(row)).select(
        *[F.col(f"{row}.`{c}`").alias(c) for c in cols])
