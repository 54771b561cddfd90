"""matchloom: batch semantic matching of two text corpora, written as Spark DataFrame jobs.

* ``functions``  column expressions (text, keys, taxonomy, skills, scores)
* ``sources``    readers and writers
* ``operators``  DataFrame-to-DataFrame building blocks
* ``plans``      the end-to-end jobs composed from the operators
* ``streaming``  Structured Streaming twins of the batch folds
* ``catalog``    named queries over the driver tables with their SQL oracles
"""

import os
import shutil
import tempfile

__version__ = "0.1.0"

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the Python workers of the session, once per application.

    Needed when the executors do not have it installed; a worker started elsewhere could not
    unpickle the functions otherwise.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(), "matchloom"), "zip", os.path.dirname(here), os.path.basename(here)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
