"""Row types. Order is data here: every table that has an order carries it as `ord`."""

from pyspark.sql import types as T

VIDEO_META = T.StructType([T.StructField("video_id", T.LongType()), T.StructField("fps", T.DoubleType()), T.StructField("frame_w", T.IntegerType()), T.StructField("frame_h", T.IntegerType()), T.StructField("total_frames", T.LongType())])
FRAMES = T.StructType([T.StructField("video_id", T.LongType()), T.StructField("frame", T.LongType()), T.StructField("image", T.BinaryType())])
BOX = T.StructType([T.StructField(n, T.FloatType()) for n in ("x1", "y1", "x2", "y2", "conf")] + [T.StructField("track_id", T.IntegerType())])
DETECTIONS = T.StructType([T.StructField("video_id", T.LongType()), T.StructField("frame", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
TRACKS = T.StructType([T.StructField("video_id", T.LongType()), T.StructField("frame", T.LongType()), T.StructField("id", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
