"""fragmenta: a PySpark-native engine for finding time fragments by text query.

Everything relational is DataFrame/SQL; Python runs only in Arrow batches where
the built-in operators cannot express the semantics.
"""

import sys

from pyspark import cloudpickle

from fragmenta.settings import SETTINGS, Settings

# Functions that run on executors travel with their code, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SETTINGS", "Settings"]
