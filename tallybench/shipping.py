"""Make this package importable in the Python workers of executors."""

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame

_shipped = set()


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the package has been added to its session's files.

    Functions that run in Python workers are pickled by reference, so executors must be
    able to import the package. The archive is built on the driver, served by Spark to
    every executor (also to those that join later), and added once per application.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        name = os.path.basename(here)
        path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-files-"), f"{name}.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, files in os.walk(here):
                for file in sorted(files):
                    if file.endswith(".py"):
                        full = os.path.join(folder, file)
                        archive.write(full, os.path.join(name, os.path.relpath(full, here)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return df
