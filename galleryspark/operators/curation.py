"""Dataset curation: stratified splits, samples and the set algebra of a validation set.

Every random choice is an md5 order over ``seed:key`` with the key as tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from galleryspark.functions import text as T
from galleryspark.operators.ordering import hash_key, hash_rank, sample_n
from galleryspark.session import cut_lineage


def uniform(seed: int | Column, key: Column) -> Column:
    """Hash-derived number in [0, 1)."""
    return F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _n_train(n: Column, ratio: float, minimum: str, seed: int | Column, stratum: Column) -> Column:
    cut = F.floor(n * F.lit(ratio))
    if minimum == "one":
        return F.greatest(F.lit(1), cut)
    if minimum == "bernoulli":
        return F.when(cut == 0, (uniform(seed, stratum) < ratio).cast("bigint")).otherwise(cut)
    if minimum == "zero":
        return cut
    raise ValueError(f"unknown minimum {minimum!r}")


def assign_split(units: DataFrame, ratio: float, seed: int | Column, key: Column, by: Sequence[str] = (), minimum: str = "one") -> DataFrame:
    """Add ``split`` (train/test) to one row per unit, stratified by ``by``."""
    ranked = hash_rank(units, seed, key, by=by, rank="_rank", total="_total")
    stratum = F.col(by[-1]) if by else F.lit("")
    train = F.col("_rank") <= _n_train(F.col("_total"), ratio, minimum, seed, stratum)
    return ranked.withColumn("split", F.when(train, "train").otherwise("test")).drop("_rank", "_total")


def stratified_split(
    df: DataFrame, class_col: str, group_col: str, ratio: float = 0.8, seed: int = 42, minimum: str = "one"
) -> DataFrame:
    """Split whole groups per class, all rows of a group on the same side.

    ``minimum``: ``one`` keeps a group of every class for training; ``bernoulli`` does so with
    probability ``ratio`` where the floor is 0; ``zero`` takes the floor as it is.
    """
    groups = cut_lineage(df.select(class_col, group_col).distinct())  # read for the sizes and for the ranks
    # One struct key, which is equal also where the class or the group is null.
    split = assign_split(groups, ratio, seed, F.col(group_col), [class_col], minimum)
    unit = F.struct(class_col, group_col).alias("_unit")
    return df.withColumn("_unit", unit).join(split.select(unit, "split"), "_unit").select(*df.columns, "split")


def component_split(df: DataFrame, class_col: str, key: Column, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Split single components per class. Groups may fall on both sides; ``leakage`` shows them."""
    return assign_split(df, ratio, seed, key, [class_col], "zero")


def flat_split(df: DataFrame, key: Column, ratio: float = 0.8, seed: int = 42, minimum: str = "one") -> DataFrame:
    """Split all rows without classes."""
    return assign_split(df, ratio, seed, key, (), minimum)


def leakage(split: DataFrame, group_col: str) -> DataFrame:
    """Groups found on both sides of the split."""
    sides = split.groupBy(group_col).agg(F.min("split").alias("_a"), F.max("split").alias("_b"))
    return sides.where(F.col("_a") != F.col("_b")).select(group_col)


def detect_layout(files: DataFrame, root: str) -> DataFrame:
    """Directory layout of the image files: one row with both detection rules.

    ``layout``: flat (stem directories below the root), classes (class/stem), or loose files.
    ``nested``: flat when some child directory of the root holds PNG files itself, else nested.
    """
    relative = T.relative_to(F.col("path"), root)
    depth = F.size(F.split(relative, "/"))
    png = T.suffix(F.col("path")) == ".png"
    facts = files.select(depth.alias("depth"), png.alias("png")).agg(
        F.coalesce(F.bool_or(F.col("depth") == 2), F.lit(False)).alias("two"),
        F.coalesce(F.bool_or(F.col("depth") == 3), F.lit(False)).alias("three"),
        F.coalesce(F.bool_or((F.col("depth") == 2) & F.col("png")), F.lit(False)).alias("png_two"),
    )
    return facts.select(
        F.when(F.col("two"), "flat").when(F.col("three"), "classes").otherwise("loose").alias("layout"),
        F.when(F.col("png_two"), "flat").otherwise("nested").alias("nested"),
    )


def repeated_splits(
    df: DataFrame, class_col: str, group_col: str, runs: int, base_seed: int = 42, ratio: float = 0.8, minimum: str = "one"
) -> DataFrame:
    """Row counts per run and split; run i uses seed base + i. Works on one row per group and run."""
    groups = cut_lineage(df.groupBy(class_col, group_col).agg(F.count(F.lit(1)).alias("_rows")))
    numbered = groups.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    seeded = numbered.withColumn("_seed", F.col("_i") + base_seed)
    named = seeded.withColumn("run", T.run_name(F.col("_i") + 1, F.col("_seed")))
    split = assign_split(named, ratio, F.col("_seed"), F.col(group_col), ["run", class_col], minimum)
    return split.groupBy("run", "split").agg(F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("groups"))


def class_index(df: DataFrame, class_col: str) -> DataFrame:
    """0-based index of each class in sorted order. The window runs over one row per class."""
    ordered = Window.partitionBy(F.lit(0)).orderBy(class_col)
    return df.select(class_col).distinct().withColumn("class_index", (F.row_number().over(ordered) - 1).cast("int"))


def sample_seeds(labelled: DataFrame, n: int, seed: int = 42, key: str = "path") -> DataFrame:
    return sample_n(labelled, n, seed, F.col(key))


def select_ground_truth(
    seeds: DataFrame, pool: DataFrame, max_gt: int = 15, seed: int = 42, key: str = "path", class_col: str = "category"
) -> DataFrame:
    """(seed, member): up to ``max_gt`` others of the seed's class, drawn without replacement.

    The class stands in hash order on a ring and a seed takes the places after its own, so each seed
    has its own draw and is joined to at most max_gt rows, however large its class.
    """
    ring = hash_rank(pool.select(class_col, key), seed, F.col(key), by=[class_col], rank="_place", total="_n")
    own = ring.join(seeds.select(key), key)
    steps = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(max_gt).cast("bigint"), F.col("_n") - 1))
    wanted = own.where(F.col("_n") > 1).select(
        F.col(key).alias("seed"), class_col, F.explode(steps).alias("step"), "_place", "_n"
    )
    wanted = wanted.select("seed", class_col, (F.pmod(F.col("_place") - 1 + F.col("step"), F.col("_n")) + 1).alias("_place"))
    return wanted.join(ring.drop("_n"), [class_col, "_place"]).select("seed", F.col(key).alias("member"))


def sample_distractors(universe: DataFrame, used: DataFrame, n: int, seed: int = 42, key: str = "path") -> DataFrame:
    """Up to ``n`` items of the universe that are not used."""
    free = universe.select(key).distinct().join(used.select(key), key, "left_anti")
    return sample_n(free, n, seed, F.col(key))


def build_validation_sets(
    labelled: DataFrame, unlabelled: DataFrame, seeds: DataFrame, ground_truth: DataFrame, distractors: DataFrame, key: str = "path"
) -> DataFrame:
    """(part, key) rows: V = seeds + ground truth + distractors; T_small = labelled - V;
    T_large = (labelled + unlabelled) - V."""
    v = (
        seeds.select(key)
        .unionByName(ground_truth.select(F.col("member").alias(key)))
        .unionByName(distractors.select(key))
        .distinct()
    )
    small = labelled.select(key).distinct().join(v, key, "left_anti")
    large = labelled.select(key).unionByName(unlabelled.select(key)).distinct().join(v, key, "left_anti")
    tagged = lambda df, part: df.select(F.lit(part).alias("part"), key)
    return tagged(v, "V").unionByName(tagged(small, "T_small")).unionByName(tagged(large, "T_large"))


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("part").agg(F.count(F.lit(1)).alias("size"))


def label_validation_groups(seeds: DataFrame, ground_truth: DataFrame, distractors: DataFrame, seed: int = 42, key: str = "path") -> DataFrame:
    """(group_name, label, member): one group per seed, numbered from 0; each distractor alone with
    label -1. An item may be in several groups, once in each."""
    numbered = hash_rank(seeds.select(key), seed, F.col(key), rank="_n").withColumn("label", (F.col("_n") - 1).cast("int"))
    own = numbered.select("label", F.col(key).alias("member"))
    others = ground_truth.join(numbered.select(F.col(key).alias("seed"), "label"), "seed").select("label", "member")
    groups = own.unionByName(others).distinct().withColumn("group_name", F.format_string("group_%03d", "label"))
    singles = hash_rank(distractors.select(key), seed, F.col(key), rank="_n").select(
        F.lit(-1).alias("label"), F.col(key).alias("member"), F.format_string("distractor_%04d", F.col("_n") - 1).alias("group_name")
    )
    return groups.unionByName(singles)


def count_for_mode(files: DataFrame, instance: Column, mode: str) -> DataFrame:
    """PNG files per instance directory: its own (instance), those in large_components (component) or both."""
    own = T.parent_name(F.col("path")) != "large_components"
    wanted = {"instance": own, "component": ~own, "both": F.lit(True)}[mode]
    png = T.suffix(F.col("path")) == ".png"
    return files.groupBy(instance.alias("instance")).agg(F.sum((png & wanted).cast("bigint")).alias("files"))


def expand_to_components(images: DataFrame, components: DataFrame, image_key: str, component_key: str) -> DataFrame:
    """Each image becomes its components, or stays itself where it has none."""
    parts = components.select(image_key, F.col(component_key).alias("_part"))
    joined = images.select(image_key).join(parts, image_key, "left")
    return joined.select(image_key, F.coalesce(F.col("_part").cast("string"), F.col(image_key).cast("string")).alias("item"))


def apply_review(
    labelled: DataFrame, unlabelled: DataFrame, seeds: DataFrame, reviewed: DataFrame, new_distractors: DataFrame, key: str = "path"
) -> DataFrame:
    """Sets after a review: the ground truth is replaced by the reviewed (seed, member) rows of known
    seeds and the distractors by the new ones."""
    known = reviewed.join(seeds.select(F.col(key).alias("seed")), "seed", "left_semi")
    return build_validation_sets(labelled, unlabelled, seeds, known, new_distractors, key)
