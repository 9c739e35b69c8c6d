"""Making the package known to a running session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_seamline_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of this session, once.

    Not needed where it is installed on all nodes or given as ``--py-files``.
    """
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="seamline-code-")) / "seamline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)
