"""panelspark: unit x time panel analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from panelspark.session import build_session  # noqa: E402

__all__ = ["build_session"]
__version__ = "0.1.0"
