"""Operators of a training-data pipeline: search, counts, filters, de-duplication, scoring, tokenising."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the tasks with their code, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
