"""lodevec: vector, text and table operators for PySpark.

Every operator takes and returns lazy DataFrames.  Sub-packages:

* ``functions``  column builders: vector arithmetic, quantisation, text
* ``operators``  search, ranking, change feeds, compaction, schema drift
* ``sources``    the snapshot table (log, deletes, evolution, maintenance)
* ``plans``      file pruning, the query catalogue and its SQL twins
* ``streaming``  idempotent sinks and stateful stream operators
* ``llm``        training-data operators; nothing outside imports it
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
