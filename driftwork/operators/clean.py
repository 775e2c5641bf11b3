"""Cleaning within a frame: boxes to points, untracked points, leader clustering, the most confident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwork.config import CleanConfig
from driftwork.functions import scalars
from driftwork.operators.frames import frame_arrays


def box_centroids(boxes: DataFrame) -> DataFrame:
    """boxes(video_id, frame, boxes array<struct<x1,y1,x2,y2,conf,track_id>>) to points in detector order; a missing track id is -1."""
    rows = boxes.select("video_id", "frame", F.posexplode("boxes").alias("ord", "b"))
    middle = lambda a, b: (F.col(f"b.{a}").cast("double") + F.col(f"b.{b}").cast("double")) / F.lit(2.0)
    return rows.select("video_id", "frame", F.col("ord").cast("long").alias("ord"), middle("x1", "x2").alias("x"), middle("y1", "y2").alias("y"), F.col("b.conf").alias("conf"), F.coalesce("b.track_id", F.lit(-1)).alias("track_id"))


def drop_untracked(points: DataFrame) -> DataFrame:
    return points.where("track_id <> -1")


def dedup_leaders(points: DataFrame, eps: float) -> DataFrame:
    """Leader clustering of each frame in order: a point joins the first leader within eps, else leads.

    The most confident member stands for its cluster (the first on ties), with its own place, in single precision.
    Pure expressions: one fold over the frame's points.
    """
    nested = frame_arrays(points.select("video_id", "frame", "ord", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.col("conf").cast("float").alias("conf"), F.col("track_id").cast("int").alias("track_id")))
    rows = nested.withColumn("c", leaders(F.col("dets"), eps)).select("video_id", "frame", F.posexplode("c").alias("ord", "p"))
    return rows.select("video_id", "frame", F.col("ord").cast("long").alias("ord"), F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"), F.col("p.conf").alias("conf"), F.col("p.track_id").alias("track_id"))


def leaders(points: Column, eps: float) -> Column:
    """The clusters of an array of points (x, y, conf: float, track_id: int), in order, each with its leader's place (lx, ly) and its best member."""
    kind = "array<struct<lx:float,ly:float,x:float,y:float,conf:float,track_id:int>>"

    def fold(held, p):
        near = lambda c: scalars.distance32(p["x"] - c["lx"], p["y"] - c["ly"]) <= F.lit(eps).cast("float")
        lead = F.struct(p["x"].alias("lx"), p["y"].alias("ly"), p["x"].alias("x"), p["y"].alias("y"), p["conf"].alias("conf"), p["track_id"].alias("track_id"))

        def put(at):
            """The clusters with p in the one at this place; 0: a new one."""
            old = F.get(held, at - 1)
            better = F.struct(old["lx"].alias("lx"), old["ly"].alias("ly"), *(p[k].alias(k) for k in ("x", "y", "conf", "track_id")))
            stays = F.when(p["conf"] > old["conf"], F.concat(F.slice(held, 1, at - 1), F.array(better), F.slice(held, at + 1, F.size(held)))).otherwise(held)
            return F.when(at == 0, F.concat(held, F.array(lead))).otherwise(stays)

        # an array of one binds the place, so that it is found once for each point
        return F.get(F.transform(F.array(F.array_position(F.transform(held, near), True).cast("int")), put), 0)

    return F.aggregate(points, F.array().cast(kind), fold)


def top_by_confidence(points: DataFrame, k: int) -> DataFrame:
    """The k most confident points of each frame, from the most confident on; ties keep their order."""
    rank = F.row_number().over(Window.partitionBy("video_id", "frame").orderBy(F.desc("conf"), "ord"))
    return points.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("ord", (F.col("rank") - 1).cast("long")).drop("rank")


def clean(points: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """Tracked points, and with dedup one for each cluster and the top k."""
    points = drop_untracked(points)
    return top_by_confidence(dedup_leaders(points, config.eps), config.top_k) if config.dedup else points


def clean_frames(boxes: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """frames(video_id, frame, dets array<struct<ord, x, y, conf, track_id>>) of boxes(video_id, frame, boxes): what box_centroids and clean give, within
    each row, so that it holds for streams. Every frame has a row."""
    middle = lambda a, b, side: ((b[f"{side}1"].cast("double") + b[f"{side}2"].cast("double")) / F.lit(2.0)).cast(a)
    size = "float" if config.dedup else "double"
    points = F.transform("boxes", lambda b, i: F.struct(i.cast("long").alias("ord"), middle(size, b, "x").alias("x"), middle(size, b, "y").alias("y"), b["conf"].cast("float").alias("conf"), F.coalesce(b["track_id"], F.lit(-1)).alias("track_id")))
    points = F.filter(points, lambda p: p["track_id"] != -1)
    whole = lambda p, i: F.struct(i.cast("long").alias("ord"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), p["conf"].alias("conf"), p["track_id"].alias("track_id"))
    if not config.dedup:
        return boxes.select("video_id", "frame", points.alias("dets"))
    ranked = F.array_sort(F.transform(leaders(points, config.eps), lambda p, i: F.struct((-p["conf"]).alias("m"), i.alias("i"), *(p[k].alias(k) for k in ("x", "y", "conf", "track_id")))))
    return boxes.select("video_id", "frame", F.transform(F.slice(ranked, 1, config.top_k), whole).alias("dets"))
