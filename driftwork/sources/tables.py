"""Detection and track tables in CSV files, bound by column name, in the order of their rows.

A table may be one file or a folder of them. Its rows have one total order, whatever Spark makes of it: files by name (numbers in names by
value), then the block of a file, then the row within it. Writers sort by ranges and name files in that order, so no task writes a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("frame", "x", "y")
_PLACE = ("__file", "__block", "__row")


def natural(name: Column) -> Column:
    """Names compare by this as people sort them: numbers within them by value."""
    part = lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(F.ltrim(p, F.lit("0"))).cast("string"), 4, "0"), F.ltrim(p, F.lit("0")))).otherwise(p)
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), part), "")


def placed(raw: DataFrame) -> DataFrame:
    """raw, read from files, with the three columns that order its rows."""
    named = raw.select("*", natural(F.col("_metadata.file_path")).alias(_PLACE[0]), F.col("_metadata.file_block_start").alias(_PLACE[1]), F.monotonically_increasing_id().alias(_PLACE[2]))
    return named.toDF(*(f"c{i}" for i in range(len(raw.columns))), *_PLACE)


def load_detections(spark: SparkSession, path: str, video_id: int = 0) -> DataFrame:
    """detections(video_id, frame, ord, x, y) of one video's CSV file, or of a folder of such files with one header.

    Columns are found by name, whatever their order and case; further columns are ignored, of equal names the first counts. Blank rows and
    rows of empty cells are skipped. A missing file, a missing column, a row too short and a cell that is no number are errors, and so is
    a coordinate that is not finite. Within a frame the order is that of the rows: across the files, by their names, and within each.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    # the header as it is written: Spark renames columns that differ in case only
    line = spark.read.text(path).where("_metadata.file_block_start = 0").first()
    header = [h.strip().strip('"').strip().lower() for h in (line.value if line else "").lstrip("﻿").split(",")]
    missing = [c for c in REQUIRED if c not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    rows = placed(raw)
    filled = " or ".join(f"coalesce(trim(c{i}), '') <> ''" for i in range(len(raw.columns)))
    cell = lambda name, kind: F.coalesce(F.trim(F.col(f"c{header.index(name)}")), F.raise_error(F.lit(f"a row has no {name}"))).cast(kind)
    rows = rows.where(filled).select(F.lit(video_id).cast("long").alias("video_id"), cell("frame", "long").alias("frame"), cell("x", "double").alias("x"), cell("y", "double").alias("y"), *_PLACE)
    bad = "isnan(x) or isnan(y) or abs(x) = double('infinity') or abs(y) = double('infinity')"
    rows = rows.withColumn("x", F.when(F.expr(bad), F.raise_error(F.lit("a coordinate is not finite")).cast("double")).otherwise(F.col("x")))
    order = Window.partitionBy("frame").orderBy(*_PLACE)
    return rows.withColumn("ord", (F.row_number().over(order) - 1).cast("long")).select("video_id", "frame", "ord", "x", "y")


def _write(rows: DataFrame, keys: list[str], columns: list[Column | str], path: str, mode: str) -> None:
    """Folders path/video_id=N of CSV files with a header each; by keys, in the order of their names. Ranges of rows are written by tasks of their own."""
    rows.orderBy("video_id", *keys).select("video_id", *columns).write.partitionBy("video_id").mode(mode).option("header", True).csv(path)


def write_detections(detections: DataFrame, path: str, mode: str = "overwrite") -> None:
    """frame, orig_id, x, y by frame and order, since on loading the files' order is the detections' order.

    Each video has a folder of its own, path/video_id=N, which load_detections reads.
    """
    _write(detections, ["frame", "ord"], ["frame", F.col("ord").alias("orig_id"), "x", "y"], path, mode)


def write_tracker(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """frame, track_id, x, y, conf in a folder for each video, the most confident first within a frame."""
    _write(points, ["frame", "ord"], ["frame", "track_id", "x", "y", "conf"], path, mode)


def write_tracks(tracks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """frame, id, x, y in a folder for each video, by id and frame."""
    _write(tracks, ["id", "frame"], ["frame", "id", "x", "y"], path, mode)


def load_tracks(spark: SparkSession, path: str) -> DataFrame:
    """tracks(video_id, frame, id, x, y) of what write_tracks has written, of all videos."""
    return spark.read.option("header", True).option("basePath", path).schema("frame long, id int, x double, y double, video_id long").csv(path).select("video_id", "frame", "id", "x", "y")


def detections_or(spark: SparkSession, path: str, detect, must_exist: bool = True, video_id: int = 0) -> DataFrame:
    """The saved detections; where there are none, an error, or what detect() gives."""
    try:
        return load_detections(spark, path, video_id)
    except FileNotFoundError:
        if must_exist:
            raise
        return detect()
