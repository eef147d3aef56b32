"""Relationship-graph and corpus analytics for long-form text, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python steps travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
