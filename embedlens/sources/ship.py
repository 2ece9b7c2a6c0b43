"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

import embedlens

_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(embedlens.__file__).parent
    path = Path(tempfile.mkdtemp(prefix="embedlens-ship-")) / "embedlens.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, os.path.join("embedlens", f.relative_to(root)))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shipped(query):
    """The query, with the package sent to the executors first."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
