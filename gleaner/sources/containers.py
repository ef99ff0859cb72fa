"""Tables in memory or in files as DataFrames with a row number."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import npy


def rows(spark: SparkSession, x) -> DataFrame:
    """(row_id, values) of a .npy path, an array or a pandas frame, (row_id, ...) of a Parquet path; a DataFrame as it is."""
    if isinstance(x, DataFrame):
        return x
    if isinstance(x, str):
        if x.endswith(".npy"):
            return npy.load(spark, x)
        if x.endswith(".parquet"):
            return spark.read.parquet(x)
        raise ValueError(f"file format not supported: {x}")
    if isinstance(x, pd.DataFrame):
        x = x.to_numpy()
    if isinstance(x, np.ndarray):
        x = x.reshape(len(x), -1)
        return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(x)), "values": x.astype(float).tolist()}), "row_id long, values array<double>")
    raise ValueError(f"input type not supported: {type(x).__name__}")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``; one of our own only in a local session without it."""
    from pathlib import Path

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        root = tempfile.mkdtemp(prefix="gleaner-")
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"arrays need a file system that driver and executors share, not {root}")
    path = Path(root.removeprefix("file://").removeprefix("file:")) / f"arrays-{uuid.uuid4().hex}"
    path.mkdir(parents=True)
    return str(path)
