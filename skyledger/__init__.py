"""Spark-native analytics over archives of astronomical frames.

Every operator is a function from DataFrames to a DataFrame; nothing here
starts a session of its own except `skyledger.session.local_session`.
"""

import sys

from pyspark import cloudpickle

# functions for Python workers travel with their code, so that executors needn't have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
