"""Operators for preparing training data; nothing else in the library imports this package.

``QUERIES`` and ``SQL`` hold the registered queries and, where SQL can say it, what they must
agree with.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors get the functions of this package by value, so that they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .catalog import QUERIES, SQL  # noqa: E402

__all__ = ["QUERIES", "SQL"]
