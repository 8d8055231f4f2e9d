"""Sequencing-read analytics as DataFrame operators, sources and sinks."""

import sys

from pyspark import cloudpickle

#: Python stages and sources travel to the executors inside the closure, so no file has to be shipped beside them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
