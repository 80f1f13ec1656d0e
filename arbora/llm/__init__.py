"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from pyspark import cloudpickle

import arbora.llm as _self

# Executors get the functions of this package by value: they need no copy of the repository.
cloudpickle.register_pickle_by_value(_self)
