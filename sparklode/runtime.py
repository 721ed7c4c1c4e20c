"""What a cluster needs to run this package: its code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to all executors, once a context; on one machine they import it from where it lies."""
    sc = spark.sparkContext
    if getattr(sc, "_sparklode", False):
        return
    sc._sparklode = True
    root = os.path.dirname(os.path.abspath(__file__))
    if sc.master.startswith("local") and "cluster" not in sc.master:
        env = sc.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if os.path.dirname(root) not in paths:
            env["PYTHONPATH"] = os.pathsep.join([*paths, os.path.dirname(root)])
        return
    # The driver serves this file to the executors for as long as it runs.
    folder = tempfile.mkdtemp(prefix="sparklode-")
    atexit.register(shutil.rmtree, folder, True)
    name = os.path.join(folder, "sparklode.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    out.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(root)))
    sc.addPyFile(name)
