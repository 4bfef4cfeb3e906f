"""Listings of files and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from galleryspark.functions import text as T
from galleryspark.operators.inventory import IMAGE_SUFFIXES, select_files


def scan_files(
    spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str] = IMAGE_SUFFIXES, recursive: bool = True
) -> DataFrame:
    """(path, length, modificationTime) of the files below the roots, each once.

    File contents are not read: the source leaves out what is not selected. A missing root is an error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    listing = reader.load(list(roots)).select("path", "length", "modificationTime")
    plain = listing.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    return select_files(plain, suffixes)


def list_members(archives: DataFrame) -> DataFrame:
    """(archive, member, size, content) of ZIP files given as (archive, content). Anything else is an error.

    Members are handed on one by one; a task holds one archive and one member.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["archive"], pdf["content"]):
                if not archive.lower().endswith(".zip"):
                    raise ValueError(f"unsupported archive {archive!r}: only .zip files can be read")
                with zipfile.ZipFile(io.BytesIO(content)) as opened:
                    for info in opened.infolist():
                        if not info.is_dir():
                            data = opened.read(info)
                            yield pd.DataFrame({"archive": [archive], "member": [info.filename], "size": [len(data)], "content": [data]})

    return archives.select("archive", "content").mapInPandas(members, "archive string, member string, size bigint, content binary")


def scan_archive(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Members of the archives at the given paths, one archive per split of the file source."""
    files = spark.read.format("binaryFile").load(list(paths))
    return list_members(files.select(F.regexp_replace("path", "^file:/*", "/").alias("archive"), "content"))


def pack_archives(files: DataFrame) -> DataFrame:
    """(archive, content): ZIP files made from rows (archive, member, content), one per archive name.

    The inverse of ``list_members``, for archives of bounded size.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as target:
            for member, content in zip(pdf["member"], pdf["content"]):
                target.writestr(member, content)
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "content": [buffer.getvalue()]})

    return files.groupBy("archive").applyInPandas(pack, "archive string, content binary")


def page_files(files: DataFrame) -> DataFrame:
    """PDF files of a listing with their class, the parent directory."""
    return files.where(T.suffix(F.col("path")) == ".pdf").withColumn("class_label", T.parent_name(F.col("path")))
