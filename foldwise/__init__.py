"""A Spark-native engine for similarity deduplication and delta coding of record collections."""

from __future__ import annotations

from pathlib import Path


def ship(spark) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose nodes lack that path, submit the package with ``--py-files``.
    """
    root, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        known["PYTHONPATH"] = ":".join([root, *paths])
