"""File inventory operators over a listing with a ``path`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from galleryspark.functions import text as T
from galleryspark.operators.ordering import hash_rank

# Fixed list of directory names left out of roll-ups.
IGNORED = (".git", "__pycache__", ".idea", ".vscode", "node_modules")
# Fixed list of image file suffixes.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")


def select_files(listing: DataFrame, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Files with one of the suffixes, upper or lower case, each path once."""
    return listing.where(T.suffix(F.col("path")).isin(*[s.lower() for s in suffixes])).dropDuplicates(["path"])


def with_path_columns(df: DataFrame, root: str) -> DataFrame:
    path = F.col("path")
    return df.withColumns(
        {
            "filename": T.filename(path),
            "stem": T.stem(path),
            "suffix": T.suffix(path),
            "parent": T.parent_name(path),
            "class_name": T.class_under(path, root),
        }
    )


def page_manifest(pdfs: DataFrame, mode: str, root: str, out_root: str, preserve_structure: bool = True) -> DataFrame:
    """(source_pdf, class_label, page_index, image_path), one row per page image.

    ``first_page``: the first page only, blanks become underscores, the relative directory is kept.
    ``all_pages``: every page, a page suffix only where a file has several pages.
    """
    path = F.col("path")
    out = out_root.rstrip("/")
    relative_dir = F.regexp_extract(T.relative_to(path, root), r"^(.*/)?[^/]*$", 1)
    base = pdfs.where(T.suffix(path) == ".pdf").select(
        path.alias("source_pdf"), T.parent_name(path).alias("class_label"), relative_dir.alias("_dir"), T.stem(path).alias("_stem"), "n_pages"
    )
    if mode == "first_page":
        name = F.concat(F.lit(out + "/"), F.col("_dir"), F.translate("_stem", " ", "_"), F.lit(".png"))
        pages = base.withColumn("page_index", F.lit(0))
    elif mode == "all_pages":
        pages = base.withColumn("page_index", F.explode(F.sequence(F.lit(0), F.col("n_pages").cast("int") - 1)))
        page = F.when(F.col("n_pages") > 1, F.format_string("_p%03d", "page_index")).otherwise(F.lit(""))
        folder = F.col("_dir") if preserve_structure else F.lit("")
        name = F.concat(F.lit(out + "/"), folder, F.col("_stem"), page, F.lit(".png"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return pages.select("source_pdf", "class_label", "page_index", name.alias("image_path"))


def pending(inputs: DataFrame, *outputs: DataFrame, key: str = "path") -> DataFrame:
    """Inputs for which none of the marker tables holds a finished output."""
    for done in outputs:
        inputs = inputs.join(done.select(key), key, "left_anti")
    return inputs


def directory_rollup(files: DataFrame, root: str, ignore: Sequence[str] = IGNORED, size: str = "length") -> DataFrame:
    """(directory, depth, files, bytes) for every directory prefix below and including the root.

    Sizes are added up per directory before the prefixes are made, so the wide part of the work is one
    row per directory and prefix.
    """
    parts = F.split(F.col("path"), "/")
    kept = files.where(~F.arrays_overlap(parts, F.array(*[F.lit(i) for i in ignore])))
    per_dir = kept.groupBy(T.relative_to(T.parent_path(F.col("path")), root).alias("_rel")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_bytes")
    )
    inside = F.when(F.col("_rel") == root.rstrip("/"), F.array().cast("array<string>")).otherwise(F.split("_rel", "/"))
    with_parts = per_dir.withColumn("_parts", inside)
    prefixes = with_parts.select("_parts", "_n", "_bytes", F.explode(F.sequence(F.lit(0), F.size("_parts"))).alias("depth"))
    directory = F.concat_ws("/", F.lit(root.rstrip("/")), F.slice("_parts", 1, F.col("depth")))
    return prefixes.groupBy(directory.alias("directory"), "depth").agg(F.sum("_n").alias("files"), F.sum("_bytes").alias("bytes"))


def unique_target_names(df: DataFrame, target: str, name: str, source: str = "path", seed: int = 0) -> DataFrame:
    """``target_name``: the wanted name, with _1, _2, ... before the suffix for later copies of it.

    Copies are numbered in the hash order of their source, so one name held by a third of all files is
    still numbered by many tasks.
    """
    ranked = hash_rank(df, seed, F.col(source), by=[target, name], rank="_copy")
    stem, ending = T.stem(F.col(name)), F.regexp_extract(F.col(name), r".(\.[^.]*)$", 1)
    numbered = F.concat(stem, F.lit("_"), (F.col("_copy") - 1).cast("string"), ending)
    return ranked.withColumn("target_name", F.when(F.col("_copy") == 1, F.col(name)).otherwise(numbered)).drop("_copy")


def flat_name(df: DataFrame, root: str) -> DataFrame:
    """Relative path with its parts joined by underscores."""
    return df.withColumn("flat_name", F.translate(T.relative_to(F.col("path"), root), "/", "_"))


def artifacts(files: DataFrame, category: str) -> DataFrame:
    """Artifact files with id, tag, category and the time of the listing."""
    path = F.col("path")
    return files.where(T.is_artifact(path)).select(
        T.artifact_id(path).alias("id"),
        T.artifact_tag(path).alias("tag"),
        F.lit(category).alias("category"),
        path.alias("source_path"),
        F.current_timestamp().alias("created_at"),
    )
