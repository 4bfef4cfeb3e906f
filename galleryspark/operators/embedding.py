"""Embedding jobs with a pluggable batch function, and component indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from galleryspark.functions import text as T
from galleryspark.operators import raster as R
from galleryspark.session import cut_lineage

# A batch function takes float images [n, h, w] in 0..1 and returns vectors [n, d].
Embedder = Callable[[np.ndarray], np.ndarray]


def cosine_projection(dim: int = 16) -> Embedder:
    """Deterministic stand-in for a trained encoder: pixel j times cos((j + 1)(i + 1)), summed for output i."""

    def embed(images: np.ndarray) -> np.ndarray:
        flat = images.reshape(len(images), -1)
        place = np.arange(1, flat.shape[1] + 1)[:, None] * np.arange(1, dim + 1)[None, :]
        return flat @ np.cos(place)

    return embed


def images_from_pixels(pixels: DataFrame) -> DataFrame:
    """(image_id, h, w, px): one row per image, gray values in raster order. A row is one page or crop."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    rows = pixels.groupBy("image_id").agg(
        (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"), ordered.alias("_p")
    )
    return rows.select("image_id", "h", "w", F.transform("_p", lambda p: p["v"].cast("int")).alias("px"))


def embed(images: DataFrame, embedder: Embedder) -> DataFrame:
    """(image_id, embedding): batched inference, unit vectors. An image that cannot be read (no pixels, or
    not h * w of them) goes in as zeros, so that every input row has an output row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (h, w), part in pdf.groupby(["h", "w"], dropna=False):
                h, w = (1, 1) if pd.isna(h) or pd.isna(w) or h * w < 1 else (int(h), int(w))
                good = [p is not None and len(p) == h * w for p in part["px"]]
                stack = np.stack([np.asarray(p, dtype=float) if ok else np.zeros(h * w) for p, ok in zip(part["px"], good)])
                vectors = embedder(stack.reshape(-1, h, w) / 255.0)
                vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"image_id": part["image_id"], "embedding": list(vectors)})

    id_type = dict(images.dtypes)["image_id"]
    return images.select("image_id", "h", "w", "px").mapInPandas(run, f"image_id {id_type}, embedding array<double>")


def page_components(pixels: DataFrame, top_n: int = 5, pad: int = 2) -> DataFrame:
    """(image_id, component_index, x, y, w, h, area, px1, py1, px2, py2): the largest components of each page,
    the largest kept, or the whole page where there is none. Crops carry ``pad`` pixels of surroundings."""
    sizes = R.page_sizes(pixels)
    stats = R.component_stats(R.label_components(R.binarize(pixels, "minority").where("fg")))
    largest = Window.partitionBy("image_id").orderBy(F.desc("bbox_area"), "label")
    top = stats.withColumn("component_index", F.row_number().over(largest) - 1).where(F.col("component_index") < top_n)
    top = top.select("image_id", "component_index", "x", "y", "w", "h", F.col("bbox_area").alias("area"))
    full = {"component_index": F.lit(0), "x": F.lit(0), "y": F.lit(0), "w": F.col("page_w"), "h": F.col("page_h"), "area": (F.col("page_w") * F.col("page_h")).cast("bigint")}
    found = sizes.join(top, "image_id", "left").withColumns({c: F.coalesce(c, v) for c, v in full.items()})
    return found.select(
        "image_id", "component_index", "x", "y", "w", "h", "area",
        F.greatest(F.lit(0), F.col("x") - pad).alias("px1"), F.greatest(F.lit(0), F.col("y") - pad).alias("py1"),
        F.least("page_w", F.col("x") + F.col("w") + pad).alias("px2"), F.least("page_h", F.col("y") + F.col("h") + pad).alias("py2"),
    )


def index_components(pages: DataFrame, pixels: DataFrame, embedder: Embedder, top_n: int = 5) -> DataFrame:
    """Gallery rows for the components of every readable page: id, embedding, metadata.

    ``pages``: image_id, path. Pages without pixels are skipped. Ids are made of the page's stem and the
    component index, so indexing a page again replaces its rows.
    """
    parts = cut_lineage(page_components(pixels, top_n))  # at most top_n rows per page, read twice below
    crop = F.struct("component_index", "px1", "py1", "px2", "py2")
    boxes = parts.groupBy("image_id").agg(F.collect_list(crop).alias("_b"))  # at most top_n per page
    y, x = F.col("y"), F.col("x")
    hit = F.filter("_b", lambda b: (x >= b["px1"]) & (x < b["px2"]) & (y >= b["py1"]) & (y < b["py2"]))
    cut = pixels.join(boxes, "image_id").select(F.col("image_id").alias("page"), "y", "x", "v", F.explode(hit).alias("b"))
    crops = images_from_pixels(cut.select(F.struct("page", F.col("b.component_index").alias("component_index")).alias("image_id"), "y", "x", "v"))
    flat = crops.withColumn("image_id", F.to_json("image_id"))
    vectors = embed(flat, embedder).withColumn("_k", F.from_json("image_id", "page bigint, component_index int")).select(
        F.col("_k.page").alias("image_id"), "_k.component_index", "embedding"
    )
    path = F.col("path")
    kind = F.concat(F.lit("roi_"), F.col("component_index").cast("string"))
    return vectors.join(parts, ["image_id", "component_index"]).join(pages, "image_id").select(
        F.concat(T.stem(path), F.lit("_"), kind).alias("id"),
        "embedding",
        T.filename(path).alias("original_filename"),
        F.lit(1).alias("page_num"),
        kind.alias("component_type"),
        T.stem(path).alias("parent_pdf_id"),
        T.parent_name(path).alias("category"),
        "path",
        F.array("x", "y", "w", "h").alias("bbox"),
        "area",
    )


def indexing_report(pages: DataFrame, gallery: DataFrame) -> DataFrame:
    """Pages in total, pages indexed and skipped, components indexed."""
    indexed = gallery.select("path").distinct().withColumn("_done", F.lit(1))
    per_page = pages.join(indexed, "path", "left").agg(
        F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("_done"), F.lit(0)).alias("indexed")
    )
    parts = gallery.agg(F.count(F.lit(1)).alias("components"))
    return per_page.withColumn("_k", F.lit(1)).join(parts.withColumn("_k", F.lit(1)), "_k").select(
        "pages", "indexed", (F.col("pages") - F.col("indexed")).alias("skipped"), "components"
    )
