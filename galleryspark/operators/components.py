"""Operators on component tables: (image_id, label, x, y, w, h, page_w, page_h, n_holes, pixel_area)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from galleryspark.functions import geometry as G
from galleryspark.operators.ordering import bucketed_rank
from galleryspark.operators.quantiles import summary

TILE = 128


def bbox_area() -> Column:
    return F.col("w").cast("bigint") * F.col("h")


def drop_logo_components(components: DataFrame, boxes: DataFrame) -> DataFrame:
    """Drop components whose box centre lies in a logo box (x1, y1, x2, y2, borders included)."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    logo = boxes.select(F.col("image_id").alias("_image"), "x1", "y1", "x2", "y2")
    inside = cx.between(F.col("x1"), F.col("x2")) & cy.between(F.col("y1"), F.col("y2"))
    return components.join(logo, (F.col("image_id") == F.col("_image")) & inside, "left_anti")


def prune_simple(components: DataFrame, min_area: int = 40) -> DataFrame:
    """Drop components without holes that are smaller than ``min_area`` pixels."""
    return components.where(F.col("is_complex") | (F.col("pixel_area") >= min_area))


def select_components(components: DataFrame, top_n: int = 0, max_bbox_ratio: float = 0.9, min_bbox_area: int = 0) -> DataFrame:
    """Drop frames and specks, then keep the ``top_n`` largest boxes of each image (0 keeps all)."""
    area = bbox_area()
    page = F.col("page_w").cast("double") * F.col("page_h")
    kept = components.where((area / page <= max_bbox_ratio) & (area >= min_bbox_area))
    if top_n <= 0:
        return kept
    largest = Window.partitionBy("image_id").orderBy(area.desc(), "label")
    return kept.withColumn("_place", F.row_number().over(largest)).where(F.col("_place") <= top_n).drop("_place")


def _size_step(size: Column) -> Column:
    """Steps that rise as the size falls; sizes of 0 (and null) come last, as they do in a falling order."""
    return F.when(size > 0, -F.floor(F.log2(size) * 8)).otherwise(F.lit(1 << 20)).cast("long")


def _by_area(components: DataFrame, rank: str) -> DataFrame:
    """Rank by box area, largest first; size steps are the buckets, so a crowded image is spread."""
    area = bbox_area()
    return bucketed_rank(components, ["image_id"], _size_step(area), [area.desc(), F.col("label")], rank)


def large_and_small(components: DataFrame, top_n: int, remove_largest: bool = True) -> DataFrame:
    """Older rule: the largest box is dropped as the frame, the next ``top_n`` are large, the rest small."""
    skip = 1 if remove_largest else 0
    ranked = _by_area(components, "place").withColumn("place", F.col("place") - skip).where(F.col("place") > 0)
    return ranked.withColumn("size_class", F.when(F.col("place") <= top_n, "large").otherwise("small"))


def pad_bbox(components: DataFrame, pad: int) -> DataFrame:
    """Padded box columns px1, py1, px2, py2; boxes under two pixels are dropped."""
    box = G.pad_box(*[F.col(c) for c in ("x", "y", "w", "h", "page_w", "page_h")], pad)
    padded = components.withColumn("_b", box).withColumns({f"p{c}": F.col(f"_b.{c}") for c in ("x1", "y1", "x2", "y2")}).drop("_b")
    return padded.where((F.col("px2") - F.col("px1") >= 2) & (F.col("py2") - F.col("py1") >= 2))


def order_by_topology(components: DataFrame) -> DataFrame:
    """1-based ``place`` in the image: most holes first, then largest pixel area."""
    bucket = F.struct(-F.col("n_holes"), _size_step(F.col("pixel_area")))
    return bucketed_rank(components, ["image_id"], bucket, [F.desc("n_holes"), F.desc("pixel_area"), F.col("label")], "place")


def assign_by_box(components: DataFrame, top_n: int, remove_largest: bool = True) -> DataFrame:
    """(image_id, label, large_label): each small component with the first large one, in area order,
    whose box contains its box. An image carries at most ``top_n`` large boxes in one array."""
    split = large_and_small(components, top_n, remove_largest)
    entry = F.struct("place", F.col("label").alias("large_label"), "x", "y", "w", "h")
    large = split.where("size_class = 'large'").groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("_large"))
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    around = F.filter(
        "_large",
        lambda b: (b["x"] <= F.col("x")) & (b["y"] <= F.col("y")) & (b["x"] + b["w"] >= right) & (b["y"] + b["h"] >= bottom),
    )
    small = split.where("size_class = 'small'").join(large, "image_id")
    return small.withColumn("_hit", F.get(around, F.lit(0))).where(F.col("_hit").isNotNull()).select(
        "image_id", "label", F.col("_hit.large_label").alias("large_label")
    )


def bbox_overlaps(components: DataFrame, pad: int = 0, tile: int = TILE) -> DataFrame:
    """(image_id, a, b), a < b: boxes of an image that overlap with padding.

    Boxes meet per page tile, so a crowded page is spread over its tiles; a pair is written only in the
    tile that holds the corner of the intersection.
    """
    right, bottom = F.col("x") + F.col("w") + pad, F.col("y") + F.col("h") + pad
    cells = lambda low, high: F.sequence(F.floor(low / tile), F.floor((high - 1) / tile))
    boxes = components.where((F.col("w") + pad > 0) & (F.col("h") + pad > 0)).select(
        "image_id", "label", "x", "y", right.alias("x2"), bottom.alias("y2")
    )
    tiled = boxes.withColumn("tx", F.explode(cells(F.col("x"), F.col("x2")))).withColumn("ty", F.explode(cells(F.col("y"), F.col("y2"))))
    a, b = tiled.alias("a"), tiled.alias("b")
    same_tile = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))
    overlap = (
        (F.col("a.label") < F.col("b.label"))
        & (F.col("a.x") < F.col("b.x2")) & (F.col("b.x") < F.col("a.x2"))
        & (F.col("a.y") < F.col("b.y2")) & (F.col("b.y") < F.col("a.y2"))
    )
    once = (F.floor(F.greatest("a.x", "b.x") / tile) == F.col("a.tx")) & (F.floor(F.greatest("a.y", "b.y") / tile) == F.col("a.ty"))
    return a.join(b, same_tile & overlap & once).select("a.image_id", F.col("a.label").alias("a"), F.col("b.label").alias("b"))


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def fill_ratio_profile(components: DataFrame) -> DataFrame:
    """Description of pixel area / box area for simple and complex components."""
    ratio = {"fill_ratio": F.col("pixel_area") / F.greatest(bbox_area(), F.lit(1))}
    return summary(components, ratio, QUARTILES, ["is_complex"])


def hole_frequency(components: DataFrame) -> DataFrame:
    """Components per hole count and the share of all components."""
    counts = components.groupBy("n_holes").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per hole count
    return counts.withColumn("share", F.col("n") / total)


def component_count_stats(components: DataFrame) -> DataFrame:
    """Distribution of components per image; recommended_top_n is the floor of the third quartile."""
    counts = components.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    stats = summary(counts, {"components": F.col("n")}, QUARTILES)
    return stats.drop("metric").withColumn("recommended_top_n", F.floor("p75").cast("int"))
