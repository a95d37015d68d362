"""Operators of a training-data pipeline. Nothing outside this package and corpus_pipeline.py imports it."""

import sys

from pyspark import cloudpickle

# Python tasks carry the helpers they call, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
