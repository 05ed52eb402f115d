"""Operators for preparing training data: cleaning, near duplicates, packing and the like.

Nothing outside this package imports it. Its functions are sent to the executors by value, so the executors need
Python with numpy, pandas and pyarrow, but not this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
