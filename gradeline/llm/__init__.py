"""Training-data operators. Their task functions are pickled by value, so workers need no install."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
