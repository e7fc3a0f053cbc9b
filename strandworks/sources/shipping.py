"""Ships this package to executors that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application, unless the package's folder is on PYTHONPATH."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="strandworks-")) / "strandworks.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted([*ROOT.glob("strandworks/**/*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shipping(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run
