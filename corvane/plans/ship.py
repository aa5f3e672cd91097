"""Makes this package known to the Python workers of executors that don't have it on their path."""

from __future__ import annotations

import importlib.util
import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

_sent: set[str] = set()


def ship(spark) -> None:
    """Hands the package to Spark's own file server once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(importlib.util.find_spec("corvane").origin).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="corvane"), "corvane.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _sent.add(context.applicationId)


def shipped(query):
    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
