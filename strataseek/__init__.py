"""strataseek: hybrid retrieval and corpus preparation as Spark plans.

The package is shipped to executors by value, so a cluster needs only the
public libraries, not this repository, on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
