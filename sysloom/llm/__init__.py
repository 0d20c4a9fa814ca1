"""Operators for training-data corpora.  Nothing outside this subpackage imports it.

Functions that run inside tasks travel with the plan, so executors need the third-party
libraries only and no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
