"""Training-data operators.

Python workers receive the functions of this subpackage by value, so a cluster
needs no copy of the repository on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
