"""Spark-first analytics over document corpora: retrieval, audits, ledgers and training-data curation."""

import sys

from pyspark import cloudpickle

# Worker-side functions of this package travel with the plan, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
