"""Document-signal analytics expressed as Spark DataFrame plans."""

from __future__ import annotations

import os
from pathlib import Path


def share_code(spark):
    """Lets this session's Python workers import the package from where the driver has it (on a cluster: a shared or shipped path)."""
    root, paths = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, (root, paths.get("PYTHONPATH"))))
    return spark
