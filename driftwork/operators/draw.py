"""What would be drawn, as tables: marks with labels and trails, and a count for each frame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwork.functions import scalars
from driftwork.operators.tracks import trails

#: Pixels of a character and of a line, where no font is measured.
CHAR_W, CHAR_H = 9, 12
#: A mark's radius; place (x, y), scale and colour (b, g, r) of the count line.
RADIUS = 3
COUNT_STYLE = (20, 40, 1.0, (0, 255, 0))


def text_size(text) -> tuple:
    """(width, height) as expressions; replace it to measure a real font."""
    return F.length(text) * F.lit(CHAR_W), F.lit(CHAR_H)


@F.pandas_udf(T.StructType([T.StructField(k, T.IntegerType()) for k in "bgr"]))
def colour(ids: pd.Series) -> pd.DataFrame:
    """(b, g, r) of ids, computed once for each that occurs in a batch; null ids have none."""
    known = {i: scalars.colour_of(int(i)) for i in ids.dropna().unique()}
    return pd.DataFrame([known.get(i, (None,) * 3) for i in ids], columns=["b", "g", "r"], dtype="Int32")


def draw_list(tracks: DataFrame, meta: DataFrame, style: str = "boxed", trail: int = 0, measure: Callable = text_size) -> DataFrame:
    """A row for each mark: place, colour, label and its anchor and box, and the trail (empty unless wanted).

    boxed: the bare id, centred 12 pixels above the unrounded place; its box has 4 pixels' margin and ends at the frame's edges.
    plain: "ID: n" at +5,-5 of the whole-pixel place, moved to lie within the frame, without a box. Anchors are cut towards zero.
    """
    rows = trails(tracks, trail) if trail else tracks.withColumn("trail", F.array().cast("array<struct<x:int,y:int>>"))
    rows = rows.join(F.broadcast(meta.select("video_id", "frame_w", "frame_h")), "video_id")  # a row for each video of the run
    rows = rows.withColumns({"cx": scalars.whole(F.col("x")), "cy": scalars.whole(F.col("y")), "label": F.col("id").cast("string") if style == "boxed" else F.format_string("ID: %d", F.col("id"))})
    w, h = measure(F.col("label"))
    if style == "boxed":
        at_x, at_y = scalars.whole(F.col("x") - w / 2), scalars.whole(F.col("y") - 12)
    else:
        at_x = F.greatest(F.lit(0), F.least(F.col("cx") + 5, F.col("frame_w") - w - 1))
        at_y = F.greatest(h + 2, F.least(F.col("cy") - 5, F.col("frame_h") - 1))
    rows = rows.withColumns({"label_x": at_x.cast("int"), "label_y": at_y.cast("int")})
    low = lambda e, name: F.greatest(F.lit(0), e).cast("int").alias(name)
    high = lambda e, side, name: F.least(F.col(side) - 1, e).cast("int").alias(name)
    box = F.struct(low(F.col("label_x") - 4, "x1"), low(F.col("label_y") - h - 4, "y1"), high(F.col("label_x") + w + 4, "frame_w", "x2"), high(F.col("label_y") + 4, "frame_h", "y2"))
    box = box if style == "boxed" else F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>")
    line = F.when(F.size("trail") > 1, F.col("trail")).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    return rows.select("video_id", "frame", "id", "cx", "cy", F.lit(RADIUS).alias("radius"), colour("id").alias("color"), "label", "label_x", "label_y", box.alias("box"), line.alias("trail"))


def overlays(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """The count line of every frame, empty ones too: tracks placed in it, with its place, scale and (b, g, r)."""
    n = tracks.groupBy("video_id", "frame").agg(F.count("id").alias("n"))
    at_x, at_y, scale, color = COUNT_STYLE
    style = [F.lit(at_x).alias("x"), F.lit(at_y).alias("y"), F.lit(scale).alias("scale"), F.struct(*(F.lit(c).alias(k) for k, c in zip("bgr", color, strict=True))).alias("color")]
    rows = frames.select("video_id", "frame").join(n, ["video_id", "frame"], "left")
    return rows.select("video_id", "frame", F.format_string("Count: %d", F.coalesce("n", F.lit(0))).alias("text"), *style)
