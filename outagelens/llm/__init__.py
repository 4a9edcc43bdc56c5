"""Training-data operators (numbered 1 to 10), their registered queries and SQL.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions of this subpackage travel to the executors by value, so that workers need no copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
