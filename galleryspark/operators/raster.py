"""Operators on long rasters: one row per pixel (image_id, y, x, v), 0 black to 255 white."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from galleryspark.operators.ordering import bucketed_rank, by_key
from galleryspark.session import cut_lineage

ROW_STRIDE = 1 << 20  # pixel key y * ROW_STRIDE + x; pages are narrower than this
TILE = 256
BOX_TILE = 64


# --- intensity -------------------------------------------------------------------------------


def gray_histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


def global_histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def _image_moments(pixels: DataFrame) -> DataFrame:
    """Exact integer sums per image: n, s, ss."""
    v = F.col("v").cast("bigint")
    return pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def _variance(n: Column, s: Column, ss: Column) -> Column:
    n, s, ss = n.cast("double"), s.cast("double"), ss.cast("double")
    return F.greatest(ss * n - s * s, F.lit(0.0)) / (n * n)


def intensity_summary(pixels: DataFrame) -> DataFrame:
    """Shares of dark, middle and bright pixels, and the means of the image means and image stds."""
    v = F.col("v")
    flags = pixels.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(v.cast("bigint")).alias("s"),
        F.sum(v.cast("bigint") * v).alias("ss"),
        F.sum((v < 32).cast("bigint")).alias("dark"),
        F.sum((v >= 224).cast("bigint")).alias("bright"),
    )
    whole = flags.agg(
        F.count(F.lit(1)).alias("images"),
        F.avg(F.col("s") / F.col("n")).alias("mean_pixel"),
        F.avg(F.sqrt(_variance(F.col("n"), F.col("s"), F.col("ss")))).alias("std_pixel"),
        (F.sum("dark") / F.sum("n")).alias("dark"),
        (F.sum("bright") / F.sum("n")).alias("bright"),
    )
    return whole.select(
        "images",
        "mean_pixel",
        "std_pixel",
        F.round("dark", 4).alias("pct_dark_0_31"),
        F.round(F.lit(1.0) - F.col("dark") - F.col("bright"), 4).alias("pct_midtone_32_223"),
        F.round("bright", 4).alias("pct_bright_224_255"),
    )


def normalization_stats(pixels: DataFrame, invert: bool = False) -> DataFrame:
    """Mean of image means and mean of image population stds on [0, 1]; inversion flips the mean only."""
    m = _image_moments(pixels)
    mean = F.col("s") / F.col("n") / 255
    std = F.sqrt(_variance(F.col("n"), F.col("s"), F.col("ss"))) / 255
    return m.agg(F.avg(F.lit(1.0) - mean if invert else mean).alias("mean"), F.avg(std).alias("std"))


def image_entropy(pixels: DataFrame) -> DataFrame:
    """Entropy in bits of the 256-bin histogram of each image."""
    hist = gray_histogram(pixels)
    total = F.sum("n").over(Window.partitionBy("image_id"))  # at most 256 rows per image
    p = F.col("n") / F.col("total")
    return hist.withColumn("total", total).groupBy("image_id").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def sparsity(pixels: DataFrame, threshold: float = 0.95) -> DataFrame:
    bright = (F.col("v") / F.lit(255.0) > threshold).cast("double")
    return pixels.groupBy("image_id").agg(F.avg(bright).alias("sparsity"))


def quality_status(images: DataFrame, pixels: DataFrame) -> DataFrame:
    """corrupted where an image has no pixels, blank where its sample std on [0, 1] is under 1e-4, else ok."""
    m = _image_moments(pixels)
    n = F.col("n").cast("double")
    std = F.sqrt(_variance(F.col("n"), F.col("s"), F.col("ss")) * n / F.greatest(n - 1, F.lit(1.0))) / 255
    status = F.when(F.col("n").isNull(), "corrupted").when(std < 1e-4, "blank").otherwise("ok")
    return images.select("image_id").join(m, "image_id", "left").select("image_id", status.alias("status"))


# --- threshold -------------------------------------------------------------------------------


def otsu(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold) of largest between-class variance, the smallest on ties; 0 for one gray value."""
    hist = gray_histogram(pixels)
    upto = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    weighted = F.col("n") * F.col("v")
    sums = hist.select(
        "image_id",
        "v",
        F.sum("n").over(upto).cast("double").alias("n0"),
        F.sum(weighted).over(upto).cast("double").alias("s0"),
        F.sum("n").over(whole).cast("double").alias("n_all"),
        F.sum(weighted).over(whole).cast("double").alias("s_all"),
    )
    gap = F.col("s_all") * F.col("n0") - F.col("s0") * F.col("n_all")
    score = gap * gap / (F.col("n0") * (F.col("n_all") - F.col("n0")))
    split = F.col("n_all") > F.col("n0")
    best = F.max_by("v", F.when(split, F.struct(score.alias("score"), (-F.col("v")).alias("low"))))
    return sums.groupBy("image_id").agg(F.coalesce(best, F.lit(0)).cast("int").alias("threshold"))


def binarize(pixels: DataFrame, polarity: str = "dark", fixed: int | None = None) -> DataFrame:
    """Add ``fg``. ``dark``: foreground is v <= threshold. ``minority``: the rarer side, as long as it is
    under 95 % of the page; ties go to the dark side."""
    if fixed is not None:
        marked = pixels.withColumn("_dark", F.col("v") <= fixed)
    else:
        marked = pixels.join(otsu(pixels), "image_id").withColumn("_dark", F.col("v") <= F.col("threshold")).drop("threshold")
    if polarity == "dark":
        return marked.withColumnRenamed("_dark", "fg")
    if polarity != "minority":
        raise ValueError(f"unknown polarity {polarity!r}")
    counts = marked.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"), F.sum((~F.col("_dark")).cast("bigint")).alias("_white"))
    black = F.col("_n") - F.col("_white")
    valid = lambda c: (c > 0) & (c < F.col("_n") * 0.95)
    use_white = F.when(valid(F.col("_white")) & valid(black), F.col("_white") < black).otherwise(valid(F.col("_white")))
    sides = counts.select("image_id", use_white.alias("_use_white"))
    return marked.join(sides, "image_id").withColumn("fg", F.col("_dark") != F.col("_use_white")).drop("_dark", "_use_white")


# --- connected components --------------------------------------------------------------------


def _pixel_key(y: Column, x: Column) -> Column:
    return y.cast("bigint") * ROW_STRIDE + x


def _label_tiles(key: np.ndarray, steps: Sequence[int]) -> np.ndarray:
    """Index of the first pixel of each pixel's component. ``key`` is sorted; two pixels touch where their
    keys differ by one of the steps."""
    ends = [np.searchsorted(key, key + step) for step in steps]
    hits = [np.nonzero(key[np.minimum(e, len(key) - 1)] == key + step)[0] for e, step in zip(ends, steps)]
    a = np.concatenate(hits)
    b = np.concatenate([e[h] for e, h in zip(ends, hits)])
    root = np.arange(len(key))
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        while not np.array_equal(root, root[root]):
            root = root[root]


GROUP_PIXELS = 400_000  # pixels handed to one kernel call


def _in_chunks(pixels: DataFrame, count: int, keys: Sequence[str]):
    """Rows grouped by a hash of the keys into so many chunks that one holds about GROUP_PIXELS rows, with a
    partition for each chunk."""
    cores = pixels.sparkSession.sparkContext.defaultParallelism
    chunks = max(-(-count // GROUP_PIXELS), min(cores, -(-count // 2_000)), 1)
    chunked = pixels.withColumn("_chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks)))
    return chunked.repartition(min(chunks, 20_000), "_chunk").groupBy("_chunk")


EXTENT = {"y0": F.min, "y1": F.max, "x0": F.min, "x1": F.max}


def pixel_extent(pixels: DataFrame) -> DataFrame:
    """(y0, y1, x0, x1, n): range and number of the pixels, one row."""
    return pixels.agg(*[f(name[0]).alias(name) for name, f in EXTENT.items()], F.count(F.lit(1)).alias("n"))


def label_components(
    pixels: DataFrame, connectivity: int = 8, tile: int = TILE, image: Sequence[str] = ("image_id",), extent: DataFrame | None = None
) -> DataFrame:
    """Add ``root``, the key of the component's first pixel in raster order.

    Pages are cut into tiles and chunks of tiles are labelled in one task each, so neither a large page nor
    many small ones make a large group. Components that cross tile borders are merged by passing the
    smallest root along the border edges until nothing changes. ``extent``, one row (y0, y1, x0, x1, n), saves
    the pass that looks for the pixel range and count when the caller knows them.
    """
    keys = list(image)
    columns = [*keys, "y", "x"]
    types = dict(pixels.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", root bigint"
    width = tile + 2  # a free column keeps the ends of two rows apart
    steps = [1, width] + ([width + 1, width - 1] if connectivity == 8 else [])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy().astype(np.int64), pdf["x"].to_numpy().astype(np.int64)
        nth = pdf.groupby([*keys, "_ty", "_tx"], sort=False).ngroup().to_numpy()
        key = (nth * (tile + 1) + y % tile) * width + x % tile + 1
        order = np.argsort(key, kind="stable")
        first = _label_tiles(key[order], steps)
        return pdf[columns].iloc[order].assign(root=(y * ROW_STRIDE + x)[order][first])

    size = (pixel_extent(pixels) if extent is None else extent).first()
    tiled = pixels.select(*columns, F.floor(F.col("y") / tile).alias("_ty"), F.floor(F.col("x") / tile).alias("_tx"))
    labelled = _in_chunks(tiled, size.n or 0, [*keys, "_ty", "_tx"]).applyInPandas(label, schema)
    if not size.n or (size.y0 // tile == size.y1 // tile and size.x0 // tile == size.x1 // tile):
        return labelled
    return _merge_tiles(cut_lineage(labelled), connectivity, tile, keys)


def _merge_tiles(labelled: DataFrame, connectivity: int, tile: int, keys: list[str]) -> DataFrame:
    y, x = F.col("y"), F.col("x")
    edge = (y % tile == 0) | (y % tile == tile - 1) | (x % tile == 0) | (x % tile == tile - 1)
    border = labelled.where(edge)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    near = F.explode(F.array(*[F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy, dx in steps]))
    ask = border.select(*keys, F.col("root").alias("a"), near.alias("_p")).select(*keys, "a", F.col("_p.y").alias("y"), F.col("_p.x").alias("x"))
    edges = ask.join(border.withColumnRenamed("root", "b"), [*keys, "y", "x"]).where("a <> b").select(*keys, "a", "b").distinct()
    both = cut_lineage(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    links = cut_lineage(both.select(*keys, "a").distinct().withColumn("top", F.col("a")))
    while True:
        # The smallest root among the neighbours, then one jump to that root's own root.
        offered = both.join(links.select(*keys, F.col("a").alias("b"), F.col("top").alias("offer")), [*keys, "b"])
        lowest = offered.groupBy(*keys, "a").agg(F.min("offer").alias("offer"))
        hooked = links.join(lowest, [*keys, "a"]).select(*keys, "a", F.least("top", "offer").alias("next"), "top")
        jump = links.select(*keys, F.col("a").alias("next"), F.col("top").alias("far"))
        moved = hooked.join(jump, [*keys, "next"], "left").select(
            *keys, "a", F.least("next", F.coalesce("far", "next")).alias("new"), "top"
        )
        step = cut_lineage(moved)
        changed = step.where("new <> top").limit(1).count()
        links = step.select(*keys, "a", F.col("new").alias("top"))
        if not changed:
            break
    merged = labelled.join(links.withColumnRenamed("a", "root"), [*keys, "root"], "left")
    return merged.select(*keys, "y", "x", F.coalesce("top", "root").alias("root"))


def component_stats(labelled: DataFrame) -> DataFrame:
    """One row per component, labelled 1, 2, ... in raster order of the first pixel."""
    y, x = F.col("y"), F.col("x")
    boxes = labelled.groupBy("image_id", "root").agg(
        F.min(x).alias("x"), F.min(y).alias("y"),
        (F.max(x) - F.min(x) + 1).alias("w"), (F.max(y) - F.min(y) + 1).alias("h"),
        F.count(F.lit(1)).alias("pixel_area"),
    )
    # One row per component: stored, so that the pixels are not labelled again for the bucket sizes.
    sized = cut_lineage(boxes.withColumn("bbox_area", F.col("w").cast("bigint") * F.col("h")))
    band = F.shiftright("root", 28)  # 256 page rows
    return bucketed_rank(sized, ["image_id"], band, [F.col("root")], "label").withColumn("label", F.col("label").cast("int"))


# --- holes and topology ----------------------------------------------------------------------


def _quad_counts(pixels: DataFrame, keys: Sequence[str], inside_box: bool, n: int = 0) -> DataFrame:
    """Counts of 2x2 windows with one, three and two diagonal foreground pixels per group.

    Every pixel takes part in four windows, so windows over the border of a padded page are included;
    ``inside_box`` keeps only windows that lie in the bounding box. Where there are many pixels (``n``, if the caller knows it) they
    are dealt out by bands of rows, the last row of a band also to the next one.
    """
    y, x = F.col("y"), F.col("x")
    part = lambda qy, qx, bit: F.struct(qy.alias("qy"), qx.alias("qx"), F.lit(bit).alias("bit"))
    parts = F.array(part(y, x, 1), part(y, x - 1, 2), part(y - 1, x, 4), part(y - 1, x - 1, 8))
    band = lambda c: F.floor(c / BOX_TILE)
    banded = pixels.select(*keys, "y", "x", F.explode(F.array_distinct(F.array(band(y - 1), band(y)))).alias("_band"))
    windows = by_key(banded, *keys, "_band", n=n).select(*keys, "_band", F.explode(parts).alias("_q")).where(band(F.col("_q.qy")) == F.col("_band"))
    quads = windows.groupBy(*keys, "_band", F.col("_q.qy").alias("qy"), F.col("_q.qx").alias("qx")).agg(F.sum("_q.bit").cast("int").alias("bits"))
    if inside_box:
        box = pixels.groupBy(*keys).agg(F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(x).alias("x0"), F.max(x).alias("x1"))
        inside = F.col("qy").between(F.col("y0"), F.col("y1") - 1) & F.col("qx").between(F.col("x0"), F.col("x1") - 1)
        quads = quads.join(box, list(keys), "right").withColumn("bits", F.when(inside, F.col("bits")))
    ones = F.bit_count("bits")
    count = lambda cond: F.sum(F.coalesce(cond.cast("bigint"), F.lit(0)))
    return quads.groupBy(*keys).agg(
        count(ones == 1).alias("q1"), count(ones == 3).alias("q3"), count(F.col("bits").isin(6, 9)).alias("qd")
    )


def _euler() -> Column:
    return F.floor((F.col("q1") - F.col("q3") - 2 * F.col("qd")) / 4)


def count_holes(labelled: DataFrame, form: str = "contour") -> DataFrame:
    """(image_id, root, n_holes) from the 8-connected Euler number.

    ``contour`` pads the component, which counts exactly its inner outlines. ``crop`` looks at the tight
    crop without padding, where holes at the crop border come out differently.
    """
    if form not in ("contour", "crop"):
        raise ValueError(f"unknown form {form!r}")
    counts = _quad_counts(labelled, ["image_id", "root"], form == "crop")
    return counts.select("image_id", "root", F.greatest(F.lit(0), 1 - _euler()).cast("int").alias("n_holes"))


def topology_features(foreground: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """Betti numbers of each page: beta_0 by 4-connectivity, beta_1 holes, euler, complexity.

    ``depth`` (image_id, depth): the deepest outline of each page, as ``contours.contour_stats`` finds it; without it 0.
    """
    extent = cut_lineage(pixel_extent(foreground))  # one row
    roots = lambda c: label_components(foreground, c, extent=extent).groupBy("image_id").agg(F.count_distinct("root").alias(f"n{c}"))
    holes = _quad_counts(foreground, ["image_id"], False, extent.first().n).select("image_id", _euler().alias("chi"))
    joined = roots(4).join(roots(8), "image_id").join(holes, "image_id")
    joined = joined.join(depth, "image_id", "left") if depth is not None else joined.withColumn("depth", F.lit(0))
    beta0, beta1 = F.col("n4"), F.greatest(F.lit(0), F.col("n8") - F.col("chi"))
    return joined.select(
        "image_id",
        beta0.alias("beta_0"),
        beta1.alias("beta_1"),
        (beta0 - beta1).alias("euler"),
        (beta0 + 2 * beta1 + F.coalesce("depth", F.lit(0))).alias("complexity"),
    )


# --- regions ---------------------------------------------------------------------------------


def page_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("page_h"), (F.max("x") + 1).alias("page_w"))


def mask_region(sizes: DataFrame, ratios: Sequence[float]) -> DataFrame:
    """One box (x1, y1, x2, y2) per page from ratios of its width and height."""
    w, h = F.col("page_w"), F.col("page_h")
    return sizes.select(
        "image_id",
        F.greatest(F.lit(0), F.floor(w * ratios[0])).cast("int").alias("x1"),
        F.greatest(F.lit(0), F.floor(h * ratios[1])).cast("int").alias("y1"),
        F.least(w, F.floor(w * ratios[2])).cast("int").alias("x2"),
        F.least(h, F.floor(h * ratios[3])).cast("int").alias("y2"),
    )


def corner_regions(binary: DataFrame, corner_ratio: float = 0.10, density: float = 0.3) -> DataFrame:
    """Corner boxes whose foreground density is above ``density``."""
    sized = binary.join(page_sizes(binary), "image_id")
    ch, cw = F.floor(F.col("page_h") * corner_ratio), F.floor(F.col("page_w") * corner_ratio)
    y, x, h, w = F.col("y"), F.col("x"), F.col("page_h"), F.col("page_w")
    top, bottom, left, right = y < ch, y >= h - ch, x < cw, x >= w - cw
    box = lambda cond, *c: F.when(cond, F.struct(*[v.cast("int").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), c)]))
    zero = F.lit(0)
    boxes = F.array(
        box(top & left, zero, zero, cw, ch), box(top & right, w - cw, zero, w, ch),
        box(bottom & left, zero, h - ch, cw, h), box(bottom & right, w - cw, h - ch, w, h),
    )
    hit = sized.select("image_id", "fg", F.explode(F.filter(boxes, lambda b: b.isNotNull())).alias("b"))
    dense = hit.groupBy("image_id", "b").agg(F.avg(F.col("fg").cast("double")).alias("density"))
    return dense.where(F.col("density") > density).select("image_id", "b.x1", "b.y1", "b.x2", "b.y2")


def _with_boxes_at(pixels: DataFrame, boxes: DataFrame, flag: str, tile: int = BOX_TILE) -> DataFrame:
    """Add ``flag``: the pixel lies in a box (x1, y1 inside, x2, y2 outside) of its image.

    Boxes are listed per page tile they touch, so pixel rows meet only nearby boxes and are never doubled.
    """
    last = lambda c: F.floor((F.col(c) - 1) / tile)
    some = boxes.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).distinct()
    tiles = some.withColumn("_ty", F.explode(F.sequence(F.floor(F.col("y1") / tile), last("y2")))).withColumn(
        "_tx", F.explode(F.sequence(F.floor(F.col("x1") / tile), last("x2")))
    )
    listed = tiles.groupBy("image_id", "_ty", "_tx").agg(F.collect_set(F.struct("x1", "y1", "x2", "y2")).alias("_boxes"))
    y, x = F.col("y"), F.col("x")
    placed = pixels.withColumn("_ty", F.floor(y / tile)).withColumn("_tx", F.floor(x / tile)).join(listed, ["image_id", "_ty", "_tx"], "left")
    inside = F.exists("_boxes", lambda b: (x >= b["x1"]) & (x < b["x2"]) & (y >= b["y1"]) & (y < b["y2"]))
    return placed.withColumn(flag, F.coalesce(inside, F.lit(False))).drop("_ty", "_tx", "_boxes")


def erase_regions(pixels: DataFrame, boxes: DataFrame, fill: int = 255) -> DataFrame:
    """Set the pixels inside the boxes to ``fill``."""
    marked = _with_boxes_at(pixels, boxes, "_in")
    return marked.withColumn("v", F.when(F.col("_in"), F.lit(fill)).otherwise(F.col("v"))).drop("_in")


def topology_mask(pixels: DataFrame) -> DataFrame:
    """White out everything outside the boxes of components with holes; pages without holes stay as they are."""
    labelled = label_components(binarize(pixels).where("fg"))
    holed = component_stats(labelled).join(count_holes(labelled), ["image_id", "root"]).where("n_holes > 0")
    boxes = holed.select("image_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    marked = _with_boxes_at(pixels, boxes, "_in").join(boxes.select("image_id").distinct().withColumn("_any", F.lit(True)), "image_id", "left")
    keep = F.col("_in") | F.col("_any").isNull()
    return marked.withColumn("v", F.when(keep, F.col("v")).otherwise(F.lit(255))).drop("_in", "_any")


def fill_outlines(labelled: DataFrame) -> DataFrame:
    """(image_id, root, y, x): each component with the area its outer outline encloses.

    The free cells of the padded box are labelled by 4-connectivity; those not joined to the padding are
    enclosed.
    """
    keys = ["image_id", "root"]
    box = labelled.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    cells = box.withColumn("y", F.explode(F.sequence(F.col("y0") - 1, F.col("y1") + 1))).withColumn("x", F.explode(F.sequence(F.col("x0") - 1, F.col("x1") + 1)))
    free = cells.select(*keys, "y", "x").join(labelled.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
    # One step down and right, so that the padding has no negative coordinates.
    moved = free.select("image_id", F.col("root").alias("owner"), (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"))
    cells_of = (F.col("y1") - F.col("y0") + 3).cast("bigint") * (F.col("x1") - F.col("x0") + 3)
    extent = box.agg(
        F.min("y0").alias("y0"), F.max(F.col("y1") + 2).alias("y1"), F.min("x0").alias("x0"), F.max(F.col("x1") + 2).alias("x1"), F.sum(cells_of).alias("n")
    )
    regions = label_components(moved, 4, image=("image_id", "owner"), extent=extent).withColumnRenamed("root", "region").withColumnRenamed("owner", "root")
    outer = box.select(*keys, _pixel_key(F.col("y0"), F.col("x0")).alias("region"))
    enclosed = regions.join(outer, [*keys, "region"], "left_anti").select(*keys, (F.col("y") - 1).alias("y"), (F.col("x") - 1).alias("x"))
    return labelled.select(*keys, "y", "x").unionByName(enclosed)


def assign_small_to_large(labelled: DataFrame, top_n: int, remove_largest: bool = True) -> DataFrame:
    """(image_id, small, large): small components whose every pixel lies in the filled outline of a large
    one, the first in area order. Boxes are compared first; a page has at most ``top_n`` large ones."""
    from galleryspark.operators.components import large_and_small

    split = large_and_small(component_stats(labelled), top_n, remove_largest)
    entry = F.struct("place", F.col("root").alias("large"), "x", "y", "w", "h")
    large = split.where("size_class = 'large'").groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    around = F.filter("_l", lambda b: (b["x"] <= F.col("x")) & (b["y"] <= F.col("y")) & (b["x"] + b["w"] >= right) & (b["y"] + b["h"] >= bottom))
    pairs = split.where("size_class = 'small'").join(large, "image_id").select(
        "image_id", F.col("root").alias("small"), "pixel_area", F.explode(around).alias("_b")
    ).select("image_id", "small", "pixel_area", "_b.place", "_b.large")
    pairs = cut_lineage(pairs)  # a small table that three later steps read
    wanted = labelled.join(pairs.select("image_id", F.col("large").alias("root")).distinct(), ["image_id", "root"], "left_semi")
    fill = fill_outlines(wanted).withColumnRenamed("root", "large")
    small_pixels = labelled.withColumnRenamed("root", "small").join(pairs, ["image_id", "small"])
    covered = small_pixels.join(fill, ["image_id", "large", "y", "x"]).groupBy("image_id", "small", "large", "place", "pixel_area").agg(
        F.count(F.lit(1)).alias("_n")
    )
    whole = covered.where(F.col("_n") == F.col("pixel_area"))
    return whole.groupBy("image_id", "small").agg(F.min_by("large", "place").alias("large"))


def merge_small(labelled: DataFrame, assignment: DataFrame) -> DataFrame:
    """Pixels of assigned small components under the root of their large one."""
    moved = labelled.join(assignment.withColumnRenamed("small", "root"), ["image_id", "root"], "left")
    return moved.select("image_id", "y", "x", F.coalesce("large", "root").alias("root")).distinct()


# --- texture ---------------------------------------------------------------------------------


def edge_density(pixels: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Share of pixels whose normalised Sobel magnitude is above the threshold; borders are replicated.

    The kernel is separable: one window along image rows, one along image columns, so no task needs more
    than a line of a page.
    """
    v = F.col("v")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    before, after = F.coalesce(F.lag(v).over(row), v), F.coalesce(F.lead(v).over(row), v)
    lines = pixels.select("image_id", "y", "x", (after - before).alias("d"), (before + 2 * v + after).alias("s"))
    column = Window.partitionBy("image_id", "x").orderBy("y")
    d, s = F.col("d"), F.col("s")
    gx = F.coalesce(F.lag(d).over(column), d) + 2 * d + F.coalesce(F.lead(d).over(column), d)
    gy = F.coalesce(F.lead(s).over(column), s) - F.coalesce(F.lag(s).over(column), s)
    steps = lines.select("image_id", (gx / F.lit(2040.0)).alias("gx"), (gy / F.lit(2040.0)).alias("gy"))
    magnitude = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.lit(1e-6))
    return steps.groupBy("image_id").agg(F.avg((magnitude > threshold).cast("double")).alias("edge_density"))


def high_freq_ratio(pixels: DataFrame) -> DataFrame:
    """Share of the Fourier magnitude outside the radius min(H, W) // 8 around the zero frequency.

    The transform is done in two line passes (rows, then columns), so a task holds single lines of a page,
    never the page.
    """
    sizes = page_sizes(pixels)
    rows = pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("_l"))
    rows = rows.select("image_id", "y", F.transform("_l", lambda p: p["v"].cast("double")).alias("line"))
    id_type = dict(pixels.dtypes)["image_id"]

    def along_rows(batches):
        for pdf in batches:
            for _, part in pdf.groupby(pdf["line"].map(len)):
                spectrum = np.fft.fft(np.stack(part["line"].to_numpy()) / 255.0, axis=1)
                yield pd.DataFrame({"image_id": part["image_id"], "y": part["y"], "re": list(spectrum.real), "im": list(spectrum.imag)})

    first = rows.mapInPandas(along_rows, f"image_id {id_type}, y int, re array<double>, im array<double>")
    cells = first.select("image_id", "y", F.posexplode(F.arrays_zip("re", "im")).alias("kx", "c")).select("image_id", "y", "kx", "c.re", "c.im")
    columns = cells.groupBy("image_id", "kx").agg(F.array_sort(F.collect_list(F.struct("y", "re", "im"))).alias("_l")).join(sizes, "image_id")
    columns = columns.select(
        "image_id", "kx", "page_h", "page_w",
        F.transform("_l", lambda p: p["re"]).alias("re"), F.transform("_l", lambda p: p["im"]).alias("im"),
    )

    def along_columns(batches):
        for pdf in batches:
            for (h, w), part in pdf.groupby(["page_h", "page_w"]):
                spectrum = np.abs(np.fft.fft(np.stack(part["re"].to_numpy()) + 1j * np.stack(part["im"].to_numpy()), axis=1))
                ky = (np.arange(h) + h // 2) % h - h // 2
                kx = (part["kx"].to_numpy() + w // 2) % w - w // 2
                far = ky[None, :] ** 2 + kx[:, None] ** 2 > (min(h, w) // 8) ** 2
                yield pd.DataFrame({"image_id": part["image_id"], "total": spectrum.sum(axis=1), "high": (spectrum * far).sum(axis=1)})

    parts = columns.mapInPandas(along_columns, f"image_id {id_type}, total double, high double")
    ratio = F.sum("high") / F.greatest(F.sum("total"), F.lit(1e-8))
    return parts.groupBy("image_id").agg(ratio.alias("high_freq_energy"))


# --- pruning ---------------------------------------------------------------------------------


def _line_runs(cells: DataFrame, line: list[str], along: str) -> DataFrame:
    """(line..., s, e): the runs of consecutive ``along`` values of each line, both ends inside."""
    place = F.row_number().over(Window.partitionBy(*line).orderBy(along))
    runs = cells.withColumn("_run", F.col(along) - place).groupBy(*line, "_run")
    return runs.agg(F.min(along).alias("s"), F.max(along).alias("e")).drop("_run")


def _with_centres(runs: DataFrame, low: str, high: str) -> DataFrame:
    """Runs that hold a window of length ``k``, with its ``first`` and ``last`` centre; windows are cut at ``low`` and ``high``."""
    before = F.expr("cast(k div 2 as int)")
    first = F.when(F.col("s") == F.col(low), F.col("s")).otherwise(F.col("s") + before)
    last = F.when(F.col("e") == F.col(high), F.col("e")).otherwise(F.col("e") - (F.col("k") - 1 - before))
    return runs.withColumn("first", first).withColumn("last", last).where("first <= last")


def pruning_steps(labelled: DataFrame, rounds: int = 3, start: int = 2) -> DataFrame:
    """(image_id, root, steps): how many of the windows k = start, start + 1, ... fit into each component.

    A window that fits holds a smaller one around the same centre, so the number of sizes that fit is the number
    of rounds. Row runs give the centres at which a window fits sideways; runs of those along columns give
    the rest. A task needs no more than a line of a component.
    """
    keys = ["image_id", "root"]
    box = labelled.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    sizes = F.explode(F.array(*[F.lit(k) for k in range(start, start + rounds)]))
    rows = _line_runs(labelled.select(*keys, "y", "x"), [*keys, "y"], "x").join(box, keys).withColumn("k", sizes)
    cells = _with_centres(rows, "x0", "x1").select(*keys, "k", "y", F.explode(F.sequence("first", "last")).alias("x"))
    columns = _line_runs(cells, [*keys, "k", "x"], "y").join(box, keys)
    fits = _with_centres(columns, "y0", "y1").groupBy(*keys).agg(F.collect_set("k").alias("ks"))  # at most ``rounds``
    return box.select(*keys).join(fits, keys, "left").select(*keys, F.coalesce(F.size("ks"), F.lit(0)).alias("steps"))


def prune_preserving_topology(labelled: DataFrame, rounds: int = 3, start: int = 2) -> DataFrame:
    """(image_id, root, y, x, steps): components after opening by growing windows and regrowth inside themselves.

    ``labelled`` has one connected piece per root, as ``label_components`` makes them. Regrowth from any pixel left
    by the opening restores such a piece whole, holes included, and a round that leaves nothing is not kept: the
    pixels stay as they are, and ``steps`` says how many rounds succeed.
    """
    return labelled.select("image_id", "root", "y", "x").join(pruning_steps(labelled, rounds, start), ["image_id", "root"])


def prune_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Holes and area before and after pruning, one row per component."""
    area = lambda df, tag: df.groupBy("image_id", "root").agg(F.count(F.lit(1)).alias(f"area_{tag}"))
    holes = lambda df, tag: count_holes(df).withColumnRenamed("n_holes", f"holes_{tag}")
    steps = after.groupBy("image_id", "root").agg(F.max("steps").alias("pruning_steps"))
    keys = ["image_id", "root"]
    joined = area(before, "before").join(holes(before, "before"), keys).join(area(after, "after"), keys).join(holes(after, "after"), keys).join(steps, keys)
    reduction = (F.lit(1.0) - F.col("area_after") / F.greatest("area_before", F.lit(1))) * 100
    return joined.withColumn("area_reduction", reduction).withColumn("topology_preserved", F.col("holes_before") == F.col("holes_after"))


def preserved_rate(report: DataFrame) -> DataFrame:
    """One row: components, share with unchanged holes, mean area reduction and mean number of rounds."""
    return report.agg(
        F.count(F.lit(1)).alias("components"),
        F.avg(F.col("topology_preserved").cast("double")).alias("preserved_rate"),
        F.avg("area_reduction").alias("mean_reduction"),
        F.avg("pruning_steps").alias("mean_steps"),
    )
