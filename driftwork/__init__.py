"""Trajectory analytics over per-frame point detections, on Spark DataFrames."""
