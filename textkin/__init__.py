"""Related-text discovery on Spark: every operator takes and returns DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels that run inside Python workers travel with the plan, so executors
# need nothing installed beyond numpy, pandas and pyarrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
