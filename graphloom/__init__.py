"""graphloom: a PySpark-native engine that turns relational tables and change logs into a
property graph, and profiles, repairs and reports on the data on the way."""

from pyspark import cloudpickle as _cloudpickle

import graphloom as _self

# Functions that run on workers travel by value, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_self)

__version__ = "0.1.0"
