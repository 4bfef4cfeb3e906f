"""Outlines of a page as a tree: ink in a hole in ink, and so on, with depth and area.

Ink is joined over eight neighbours, paper over four, so that the two never cross. Every piece of ink has an outer outline and
every enclosed piece of paper an inner one; the piece left of the first pixel (in raster order) of a piece surrounds it. Paper
that reaches the border of the page belongs to the outside, which is no outline.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from galleryspark.operators.ordering import by_key
from galleryspark.operators.raster import BOX_TILE, ROW_STRIDE, _in_chunks, label_components, page_sizes
from galleryspark.session import cut_lineage

UNITS = 12  # a 2x2 window is shared out in twelfths, so that areas are added as integers
SLICE_TILES = 256


def contour_tree(binary: DataFrame, tile: int = BOX_TILE) -> DataFrame:
    """(image_id, node, ink, parent, depth, area): one row per outline; ``node`` is the key of its first pixel.

    ``binary``: every pixel of the pages (image_id, y, x, fg). ``parent`` is null for the outermost outlines, ``depth`` counts the
    outlines around one. ``area`` is that of the polygon through the centres of the ink pixels along the outline, all that lies
    inside included.
    """
    ink = label_components(binary.where("fg"), 8).withColumn("ink", F.lit(True))
    paper = label_components(binary.where("not fg"), 4).withColumn("ink", F.lit(False))
    pieces = cut_lineage(ink.unionByName(paper).withColumnRenamed("root", "node"))
    n = pieces.count()
    # Pixels are only counted up; the sizes of the pages are joined to the far fewer pieces.
    ends = [F.max((F.col("y") == 0) | (F.col("x") == 0)).alias("_first"), F.max("y").alias("_y"), F.max("x").alias("_x")]
    nodes = pieces.groupBy("image_id", "node", "ink").agg(*ends).join(page_sizes(binary), "image_id")
    at_edge = F.col("_first") | (F.col("_y") == F.col("page_h") - 1) | (F.col("_x") == F.col("page_w") - 1)
    nodes = cut_lineage(nodes.select("image_id", "node", "ink", (~F.col("ink") & at_edge).alias("outside")))
    real = nodes.where("not outside").select("image_id", "node", "ink")
    # The pixel left of the first one; at the left border it is the outside.
    anchors = real.withColumn("y", F.shiftright("node", 20).cast("int")).withColumn("x", (F.col("node") % ROW_STRIDE).cast("int") - 1)
    around = by_key(pieces.select("image_id", "y", "x", F.col("node").alias("parent")), "image_id", "y", "x", n=n)
    known = real.select("image_id", F.col("node").alias("parent"))
    outer = anchors.join(around, ["image_id", "y", "x"]).join(known, ["image_id", "parent"], "left_semi")
    tree = real.join(outer.select("image_id", "node", "parent"), ["image_id", "node"], "left")
    shares = _window_shares(pieces, tile, n)
    tree = tree.join(shares, ["image_id", "node"], "left").withColumn("units", F.coalesce("units", F.lit(0).cast("long")))
    return _gathered(tree).select("image_id", "node", "ink", "parent", "depth", (F.col("units") / UNITS).alias("area"))


def _gathered(tree: DataFrame) -> DataFrame:
    """Depth of every node and the units of everything below it, by pointer doubling: each round doubles the way a node looks up."""
    state = cut_lineage(
        tree.withColumn("up", F.col("parent")).withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("int"))
    )
    while state.where("up is not null").limit(1).count():
        given = state.where("up is not null").groupBy("image_id", F.col("up").alias("node")).agg(F.sum("units").alias("given"))
        above = state.select("image_id", F.col("node").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        state = cut_lineage(
            state.join(given, ["image_id", "node"], "left")
            .join(above, ["image_id", "up"], "left")
            .select(
                "image_id", "node", "ink", "parent", F.col("further").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                (F.col("units") + F.coalesce("given", F.lit(0))).alias("units"),
            )
        )
    return state


def _window_shares(pieces: DataFrame, tile: int, n: int) -> DataFrame:
    """(image_id, node, units): what each of the pieces (of ``n`` pixels) covers of the 2x2 windows of pixel centres.

    The outline cuts a window with three ink pixels along its diagonal and leaves a window of fewer to the paper. A tile gets
    the first row and column of its neighbours, so a window is seen once, in the tile of its first pixel.
    """
    y, x = F.col("y"), F.col("x")
    ty, tx = F.floor(y / tile), F.floor(x / tile)
    top, left = (y % tile == 0) & (y > 0), (x % tile == 0) & (x > 0)
    place = lambda cond, a, b: F.when(cond, F.struct(a.alias("ty"), b.alias("tx")))
    places = F.array(place(F.lit(True), ty, tx), place(top, ty - 1, tx), place(left, ty, tx - 1), place(top & left, ty - 1, tx - 1))
    seen = pieces.select("image_id", "y", "x", "node", "ink", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("_p"))
    seen = seen.select("image_id", "y", "x", "node", "ink", "_p.ty", "_p.tx")
    side = tile + 1

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        nth = pdf.groupby(["image_id", "ty", "tx"], sort=False).ngroup().to_numpy()
        piece, name = pd.factorize(pd.MultiIndex.from_arrays([pdf["image_id"], pdf["node"]]))
        row = pdf["y"].to_numpy() - pdf["ty"].to_numpy() * tile
        column = pdf["x"].to_numpy() - pdf["tx"].to_numpy() * tile
        black = pdf["ink"].to_numpy().astype(np.int8)
        units = np.zeros(len(name), dtype=np.int64)
        order = np.argsort(nth, kind="stable")
        tiles = int(nth.max()) + 1
        for start in range(0, tiles, SLICE_TILES):
            part = order[np.searchsorted(nth[order], start) : np.searchsorted(nth[order], start + SLICE_TILES)]
            shape = (min(SLICE_TILES, tiles - start), side, side)
            owner, ink = np.full(shape, -1, dtype=np.int64), np.zeros(shape, dtype=np.int8)
            at = (nth[part] - start, row[part], column[part])
            owner[at], ink[at] = piece[part], black[part]
            corners = [(slice(None), slice(a, a + tile), slice(b, b + tile)) for a in (0, 1) for b in (0, 1)]
            whole = np.logical_and.reduce([owner[c] >= 0 for c in corners])
            dark = sum(ink[c] for c in corners)
            for c in corners:
                of_ink = np.choose(dark, [0, 0, 0, 2, 3])
                of_paper = np.choose(dark, [3, 4, 6, 6, 0])
                weight = np.where(ink[c] == 1, of_ink, of_paper)[whole]
                units += np.bincount(owner[c][whole], weight, len(name)).astype(np.int64)
        return pd.DataFrame({"image_id": name.get_level_values(0), "node": name.get_level_values(1), "units": units})

    image_type = dict(pieces.dtypes)["image_id"]
    parts = _in_chunks(seen, n, ["image_id", "ty", "tx"]).applyInPandas(share, f"image_id {image_type}, node long, units long")
    return parts.groupBy("image_id", "node").agg(F.sum("units").alias("units"))


def contour_stats(tree: DataFrame, pages: DataFrame) -> DataFrame:
    """(image_id, n_contours, max_depth, mean_contour_area, std_contour_area) of every page; outlines without area count in neither
    mean nor (population) standard deviation."""
    area = F.when(F.col("area") > 0, F.col("area"))
    found = tree.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_contours"), F.max("depth").alias("max_depth"),
        F.avg(area).alias("mean_contour_area"), F.stddev_pop(area).alias("std_contour_area"),
    )
    return pages.select("image_id").distinct().join(found, "image_id", "left").fillna(0)
