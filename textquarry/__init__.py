"""textquarry: a PySpark-native text data-set engine.

Importing the package registers it with PySpark's pickler *by value*, so that functions used in
``mapInArrow``/``applyInPandas`` reach executors inside the task itself. A cluster then needs no copy of the
repository on its executors (``--py-files`` works as well).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
