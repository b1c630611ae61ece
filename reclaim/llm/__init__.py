"""Operators for preparing language-model training data.

Nothing outside this package imports it.  The functions that run inside
Python workers are pickled by value, so executors need only the public
libraries, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
