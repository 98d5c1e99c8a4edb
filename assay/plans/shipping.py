"""Getting this package to the Python workers."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from assay.session import scratch_dir
from assay.sources import stores

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, for sessions started without ``--py-files``.

    Functions that run inside tasks are imported there by name.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    target = f"{scratch_dir(spark, 'package')}/{package.name}.zip"
    stores.make_parents(target)
    with stores.open_write(target) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)
