"""Operators of a training-data pipeline: deduplication, filtering, extraction, scoring and encoding of whole corpora.

Functions that run inside tasks are pickled with their code, so workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
