"""Training-data pipeline operators (licence scan, packing, dedup, filters, sharding).

Nothing else in the library imports this subpackage; its registered queries
live in ``queries.py``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
