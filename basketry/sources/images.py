"""Image files as rows: intake rules and de-duplication."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import scalars as X
from basketry.session import materialize

# Accepted extensions and the size limit.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp")
MAX_BYTES = 10 * 1024 * 1024


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content`` of the files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row (``name``, ``content``) as a file of its own; ``name, length`` of what was written.

    A task writes under a name of its own and then renames, so a task that runs
    twice leaves each file whole and once. The folder must be one all executors share.
    """
    uri = folder if "://" in folder else f"file://{folder}"
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri

    def write(batches):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(uri)
        for pdf in batches:
            system.create_dir(place, recursive=True)
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                own = f"{place}/.{uuid.uuid4().hex}"
                with system.open_output_stream(own, compression=None) as out:
                    out.write(content)
                system.move(own, f"{place}/{name}")
            yield pd.DataFrame({"name": pdf["name"], "length": pdf["content"].map(len).astype("int64")})

    return materialize(files.select("name", "content").mapInPandas(write, "name string, length bigint"), "written-files")


def accepted(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Files with an accepted extension within the size limit.

    Both rules read file metadata only, so a refused file's content is never loaded.
    """
    extension = F.lower(F.regexp_extract("path", r"(\.[^./?#]+)$", 1))
    return files.where(extension.isin(*EXTENSIONS) & (F.col("length") <= limit))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("image_hash", X.content_hash(F.col("content")))


def first_of_each(files: DataFrame, order: str) -> DataFrame:
    """One row per content: the first by ``order``, and how many copies there were.

    Only the hash and the order column are shuffled, never the content.
    """
    return (
        with_hash(files)
        .groupBy("image_hash")
        .agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copias"))
    )
