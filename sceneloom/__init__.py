"""sceneloom: spatio-temporal scene graphs as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Task functions travel with their code: Python workers, and the helper process of
# stateful streams, need neither this package installed nor the driver's folder.
register_pickle_by_value(sys.modules[__name__])
