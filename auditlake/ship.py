"""Sends this package to the executors, so that Python workers can import it without an installed copy."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch for Python workers, unless the session says otherwise: texts and pages may be long.
BATCH_BYTES, _LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package once per Spark context, unless it came from an archive itself, and bounds Arrow batches.

    Batches are bounded in rows by default, which bounds no memory; the session's own limit, if set, holds.
    """
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    sc, root = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_auditlake_sent", False) or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="auditlake-"), "auditlake_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("auditlake", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._auditlake_sent = True
