"""Exact quantiles and moments of columns, without holding a large group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Up to this many values per group the built-in exact percentile runs in one aggregate.
DIRECT_LIMIT = 1_000_000
# Rank error of the sketch is n / ACCURACY; brackets are widened by four times that.
ACCURACY = 100_000
# More groups than this are not brought to the driver; their values are ranked by windows.
BRACKET_LIMIT = 10_000


def melt(df: DataFrame, columns: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Long form (by..., metric, v) without the nulls."""
    pairs = [F.struct(F.lit(name).alias("metric"), col.cast("double").alias("v")) for name, col in columns.items()]
    return (
        df.select(*by, F.explode(F.array(*pairs)).alias("_p"))
        .select(*by, "_p.metric", "_p.v")
        .where(F.col("v").isNotNull())
    )


MOMENTS = {
    "n": F.count,
    "mean": F.avg,
    "std_pop": F.stddev_pop,
    "std_samp": F.stddev_samp,
    "min": F.min,
    "max": F.max,
}


def exact_quantiles(
    long: DataFrame,
    probs: Sequence[float],
    by: Sequence[str] = (),
    direct_limit: int = DIRECT_LIMIT,
    accuracy: int = ACCURACY,
    bracket_limit: int = BRACKET_LIMIT,
) -> DataFrame:
    """Linear-interpolated quantiles per (by, metric): column ``q`` holds one value per prob.

    Small groups use the built-in. For large ones a sketch gives a value bracket around every
    wanted rank; one more pass counts the rows below the bracket and the values inside it, so
    only a small share of the distinct values is ever ranked.
    """
    keys = [*by, "metric"]
    if _small(long, keys, direct_limit):
        return long.groupBy(*keys).agg(_direct(probs))
    return _ranked(long, keys, probs, direct_limit, accuracy, bracket_limit)


def _small(long, keys, direct_limit) -> bool:
    biggest = long.groupBy(*keys).agg(F.count("v").alias("n")).agg(F.max("n").alias("n")).first()
    return (biggest.n or 0) <= direct_limit


def _direct(probs):
    return F.percentile("v", F.array(*[F.lit(float(p)) for p in probs])).alias("q")


def _ranked(long, keys, probs, direct_limit=DIRECT_LIMIT, accuracy=ACCURACY, bracket_limit=BRACKET_LIMIT):
    sizes = long.groupBy(*keys).agg(F.count("v").alias("n"))
    if sizes.limit(bracket_limit + 1).count() <= bracket_limit:
        counted = _bracketed(long, keys, probs, direct_limit, accuracy)
    else:
        counted = _counted_whole(long, sizes, keys, probs)
    return _interpolate(counted, keys, probs)


def _bracketed(long, keys, probs, direct_limit, accuracy):
    slack = 4.0 / accuracy
    edges = [min(1.0, max(0.0, p + sign * slack)) for p in probs for sign in (-1, 1)]
    sketch = long.groupBy(*keys).agg(
        F.count("v").alias("n"),
        F.min("v").alias("lowest"),
        F.max("v").alias("highest"),
        F.percentile_approx("v", [float(e) for e in edges], accuracy).alias("edges"),
    )
    per_prob = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"),
                    F.col("edges")[2 * i].alias("sketch_lo"),
                    F.col("edges")[2 * i + 1].alias("sketch_hi"),
                )
                for i in range(len(probs))
            ]
        )
    )
    exact = F.col("n") <= direct_limit
    brackets = sketch.select(*keys, "n", "lowest", "highest", per_prob.alias("b")).select(
        *keys,
        "n",
        F.col("b.i").alias("i"),
        F.when(exact, F.col("lowest")).otherwise(F.col("b.sketch_lo")).alias("lo"),
        F.when(exact, F.col("highest")).otherwise(F.col("b.sketch_hi")).alias("hi"),
    )
    # At most BRACKET_LIMIT groups times the probs: counted before this path was chosen.
    spark = long.sparkSession
    small = spark.createDataFrame(brackets.collect(), brackets.schema)
    inside = F.col("v") >= F.col("lo")
    return (
        long.join(F.broadcast(small), keys)
        .where(F.col("v") <= F.col("hi"))
        .groupBy(*keys, "i", "n", inside.alias("inside"), F.when(inside, F.col("v")).alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )


def _counted_whole(long, sizes, keys, probs):
    counted = long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    return (
        counted.join(sizes, keys)
        .withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(len(probs))])))
        .withColumn("inside", F.lit(True))
    )


def _interpolate(counted, keys, probs):
    upto = Window.partitionBy(*keys, "i").orderBy("inside", "v").rowsBetween(Window.unboundedPreceding, 0)
    prob = F.array(*[F.lit(float(p)) for p in probs])[F.col("i")]
    place = prob * (F.col("n") - 1)
    ranked = counted.withColumn("seen", F.sum("c").over(upto)).withColumn("place", place)
    found = ranked.where("inside").groupBy(*keys, "i", "place").agg(
        F.min(F.when(F.col("seen") > F.floor("place"), F.col("v"))).alias("a"),
        F.min(F.when(F.col("seen") > F.ceil("place"), F.col("v"))).alias("b"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))
    by_index = F.array_sort(F.collect_list(F.struct("i", value.alias("value"))))
    return found.groupBy(*keys).agg(F.transform(by_index, lambda s: s["value"]).alias("q"))


def summary(df: DataFrame, columns: Mapping[str, Column], probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Moments and named quantiles per (by, metric): one aggregate while the groups are small."""
    long, keys = melt(df, columns, by), [*by, "metric"]
    plain = [f("v").alias(name) for name, f in MOMENTS.items()]
    if _small(long, keys, DIRECT_LIMIT):
        whole = long.groupBy(*keys).agg(*plain, _direct(list(probs.values())))
    else:
        whole = long.groupBy(*keys).agg(*plain).join(_ranked(long, keys, list(probs.values())), keys)
    return whole.select(*keys, *MOMENTS, *[F.col("q")[i].alias(name) for i, name in enumerate(probs)])
