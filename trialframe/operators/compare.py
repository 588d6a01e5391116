"""Comparison of tables and of result trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.columns import any_of, col
from trialframe.functions.text import masked
from trialframe.sources.tree import matches_any, plain_path


# fixed value: files that only keep a folder alive
UNLISTED = [r"\.gitkeep$"]


def compare_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str],
                   ignore: Sequence[str] = ()) -> DataFrame:
    """Rows that differ: ``left_only``, ``right_only`` or ``diff``; texts are masked by the patterns first."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        shown = [masked(col(v).cast("string"), ignore).alias(f"{tag}_{v}") for v in values]
        return df.select(*[col(k) for k in keys], *shown, F.lit(True).alias(f"__{tag}"))

    both = side(left, "left").join(side(right, "right"), list(keys), "full")
    differs = any_of([~col(f"left_{v}").eqNullSafe(col(f"right_{v}")) for v in values])
    status = (
        F.when(F.col("__right").isNull(), F.lit("left_only")).when(F.col("__left").isNull(), F.lit("right_only"))
        .when(differs, F.lit("diff"))
    )
    shown = [col(f"{t}_{v}") for v in values for t in ("left", "right")]
    return both.withColumn("status", status).filter(F.col("status").isNotNull()).select(
        *[col(k) for k in keys], "status", *shown)


def tree_lines(spark: SparkSession, root: str, ignore_files: Sequence[str] = ()) -> DataFrame:
    """Lines of all text files below a folder: relative path, line number, text."""
    base = root.rstrip("/") + "/"
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    full = plain_path(F.col("_metadata.file_path"))
    named = files.filter(~matches_any(F.col("_metadata.file_name"), [*UNLISTED, *ignore_files]))
    path = F.substring_index(full, base, -1)
    docs = named.select(path.alias("path"), F.col("value"))
    text = docs.filter(~F.contains(F.col("value"), F.lit("\x00")) & ~F.contains(F.col("value"), F.lit("�")))
    body = F.regexp_replace(F.col("value"), r"\n\z", "")
    return text.select("path", F.posexplode(F.split(body, "\n")).alias("line_no", "line"))


def empty_files(spark: SparkSession, root: str) -> list[str]:
    """Relative paths of files without content, which Spark's file sources leave out."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    base, out = root.rstrip("/") + "/", []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0:
            out.append(status.getPath().toUri().getPath().split(base.split("://")[-1], 1)[-1])
    return out


def tree_files(spark: SparkSession, root: str, ignore_files: Sequence[str] = ()) -> DataFrame:
    """All files below a folder, empty and binary ones too: relative path, length, and a digest of those that hold no text."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    binary = text.isNull() | F.contains(text, F.lit("\x00")) | F.contains(text, F.lit("\ufffd"))
    held = files.select(F.substring_index(plain_path(F.col("path")), base, -1).alias("path"), "length",
                        F.when(binary, F.sha2("content", 256)).alias("digest"))
    none = spark.createDataFrame([(p, 0) for p in empty_files(spark, root)], "path string, length long")
    listed = held.unionByName(none.withColumn("digest", F.lit(None).cast("string")))
    return listed.filter(~matches_any(F.substring_index("path", "/", -1), [*UNLISTED, *ignore_files]))


def compare_trees(spark: SparkSession, left: str, right: str, ignore: Sequence[str] = (),
                  ignore_files: Sequence[str] = ()) -> DataFrame:
    """What differs between two folders: files (line number -1) and lines, joined by relative path and line number.

    A file on one side only is reported whatever it holds, as is a file that holds no text and has another content. Texts are
    compared line by line, with masks; whether a text is empty on one side shows as its lines.
    """
    files = compare_tables(*[
        tree_files(spark, root, ignore_files).select(
            "path", F.lit(-1).alias("line_no"), F.when(F.col("length") == 0, "empty").when(F.col("digest").isNotNull(), F.col("digest"))
            .otherwise("text").alias("line")) for root in (left, right)], ["path", "line_no"], ["line"])
    lines = compare_tables(tree_lines(spark, left, ignore_files), tree_lines(spark, right, ignore_files),
                           ["path", "line_no"], ["line"], ignore)
    return files.unionByName(lines)


def same_trees(spark: SparkSession, left: str, right: str, ignore: Sequence[str] = (),
               ignore_files: Sequence[str] = ()) -> bool:
    return compare_trees(spark, left, right, ignore, ignore_files).isEmpty()
