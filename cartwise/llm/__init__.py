"""Operators of a training-data pipeline: quality, search, packing, privacy, sharding, deduplication, mixing.

Functions of this package travel to executors with the job, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
