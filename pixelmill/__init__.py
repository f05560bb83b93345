"""pixelmill: set-oriented image-derivative processing on PySpark."""

from __future__ import annotations

import os
from pathlib import Path

__version__ = "0.1.0"


def ship(spark) -> None:
    """Lets Python workers on this machine import the package, whatever folder the session was started in. On a cluster
    the package is installed or goes with ``--py-files``."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in known:
        env["PYTHONPATH"] = os.pathsep.join([here, *known])
