"""Operators of a training-data pipeline over text and vector tables.

Nothing else in the library imports this package.  Its task-side functions are pickled by value, so
executors need numpy, pandas and pyarrow but no copy of the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
