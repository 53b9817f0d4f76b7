"""Training-data operators over document tables; nothing outside this folder imports it.

Functions of this package travel to the executors by value, so these need not have it installed.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
