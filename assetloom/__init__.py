"""assetloom: reconcile physical-asset records with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
