"""Names and paths: string functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns of the artifact files.
MERGED = r"^.+_merged\.png$"
RANDOM_SAMPLE = r"^.+_random_(0[1-9]|1[0-9]|20)\.png$"
LARGE_COMPONENT = r"^.+_large_L[0-9]+_area[0-9]+_pad2\.png$"
ARTIFACT_SUFFIX = r"(_merged|_random_[0-9]+|_large_L[0-9]+_area[0-9]+_pad2)\.png$"


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(filename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(filename(path), r".(\.[^.]*)$", 1))


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def class_under(path: Column, root: str) -> Column:
    """First directory below the root, ``_flat`` for files directly in it."""
    relative = relative_to(path, root)
    return F.when(relative.contains("/"), F.substring_index(relative, "/", 1)).otherwise(F.lit("_flat"))


def filename_template(name: Column) -> Column:
    """Base name up to the first dot, letters as L and digits as D.

    Letters go first: the other order would read the new D as a letter.
    """
    base = F.substring_index(filename(name), ".", 1)
    return F.regexp_replace(F.regexp_replace(base, r"\p{L}", "L"), r"\p{Nd}", "D")


def segment_count(path: Column) -> Column:
    return F.size(F.split(stem(path), "-"))


def class_from_prefix(name: Column) -> Column:
    return F.substring_index(name, "-", 1)


def is_artifact(path: Column) -> Column:
    name = filename(path)
    large = name.rlike(LARGE_COMPONENT) & (parent_name(path) == "large_components")
    return name.rlike(MERGED) | name.rlike(RANDOM_SAMPLE) | F.coalesce(large, F.lit(False))


def artifact_tag(path: Column) -> Column:
    name = filename(path)
    return (
        F.when(parent_name(path).contains("large_components"), "large_component")
        .when(name.contains("_merged"), "merged")
        .when(name.contains("_random_"), "random_sample")
        .otherwise("unknown")
    )


def artifact_id(path: Column) -> Column:
    """File name without its artifact suffix, the stem where there is no such suffix."""
    name = filename(path)
    return F.when(name.rlike(ARTIFACT_SUFFIX), F.regexp_replace(name, ARTIFACT_SUFFIX, "")).otherwise(stem(path))


def canonical_path(path: Column, local_root: str, shared_root: str = "/workspace") -> Column:
    """Local path to the shared form: forward slashes, local root replaced."""
    clean = F.translate(path, "\\", "/")
    root = local_root.rstrip("/")
    return F.when(clean.startswith(root), F.concat(F.lit(shared_root + "/"), F.ltrim(F.substring(clean, len(root) + 1, 1 << 30), F.lit("/")))).otherwise(clean)


def local_path(path: Column, local_root: str, shared_root: str = "/workspace") -> Column:
    clean = F.translate(path, "\\", "/")
    tail = F.ltrim(F.substring(clean, len(shared_root) + 1, 1 << 30), F.lit("/"))
    return F.when(clean.startswith(shared_root), F.concat(F.lit(local_root.rstrip("/") + "/"), tail)).otherwise(clean)


# Fixed formats of run, experiment and checkpoint names.
RUN_NAME = r"^Run_([0-9]+)_Seed_([0-9]+)$"
STAMP = r"([0-9]{8}_[0-9]{6})"


def parse_run_name(name: Column) -> Column:
    """Struct of run number and seed."""
    return F.struct(
        F.regexp_extract(name, RUN_NAME, 1).cast("int").alias("run_no"), F.regexp_extract(name, RUN_NAME, 2).cast("int").alias("seed")
    )


def run_name(run_no: Column, seed: Column) -> Column:
    return F.format_string("Run_%02d_Seed_%d", run_no.cast("int"), seed.cast("int"))


def experiment_timestamp(name: Column) -> Column:
    """Timestamp inside names such as ``exp_YYYYMMDD_HHMMSS``."""
    stamp = F.regexp_extract(name, STAMP, 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def checkpoint_name(epoch: Column) -> Column:
    return F.format_string("checkpoint_epoch_%04d", epoch.cast("int"))


def top_k_of(metric: Column) -> Column:
    return F.regexp_extract(metric, r"top([0-9]+)", 1).cast("int")
