"""Operators for preparing training text. Nothing else in the library imports this package."""

from pyspark import cloudpickle

import readloom.llm as _package

#: Python stages travel to the executors inside the closure, so no file has to be shipped beside it.
cloudpickle.register_pickle_by_value(_package)
