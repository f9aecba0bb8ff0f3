"""Operators on texts, pages and vectors.

Functions that run inside tasks are shipped with their code, so executors need the libraries they use, but no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
