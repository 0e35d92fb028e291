"""casework: customer-case text triage, retrieval and model evaluation on Spark.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column``) function.
Nothing here keeps a global session or triggers hidden actions, except where a
docstring says so (driver-side scalar checks such as a row count).
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel by value: an executor needs no copy of
# this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
