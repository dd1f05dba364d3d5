"""Send this package to the executors, once a Spark application."""

from __future__ import annotations

import os
import tempfile
import zipfile

_SENT: set[str] = set()


def ship(spark) -> None:
    """Zip the package and add it to the application, so that workers anywhere can import it."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="quillon-ship-"), "quillon_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(os.path.join(root, package)):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    _SENT.add(context.applicationId)
