"""Grouped-regression subsampling on Spark DataFrames, and operators for training-data corpora."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

__version__ = "0.1.0"

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Make this package importable in the session's Python workers; once per application.

    Not needed where it is installed on all machines or passed with --py-files.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gleaner-ship-")) / "gleaner.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
