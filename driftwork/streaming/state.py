"""What keyed streams share: the state store that several variables need, and frames of a micro-batch in order."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams of this session that start from now on keep their state in RocksDB, whose files go to their checkpoint; what runs is not touched."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(frames: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Frames with their bytes from the smallest number on, equal numbers as they came. Bytes lie in a file of the worker meanwhile, numbers and places in memory."""
    with tempfile.TemporaryFile() as file:
        places, at = [], 0
        for frame, data in frames:
            file.write(data)
            places.append((frame, at, len(data)))
            at += len(data)
        for frame, begin, size in sorted(places, key=lambda p: p[0]):
            file.seek(begin)
            yield frame, file.read(size)
