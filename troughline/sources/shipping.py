"""Make the package importable in the Python workers of a running session."""

import os
import tempfile
import zipfile

_shipped = set()


def ship_package(spark):
    """Send the package to the executors once per application, as a Python file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    handle, path = tempfile.mkstemp(prefix="troughline-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
