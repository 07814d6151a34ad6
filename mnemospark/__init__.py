"""mnemospark: analytics over long-lived memory tables, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel with their code: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
