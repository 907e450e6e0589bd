"""headroom: market-potential analytics as PySpark DataFrame plans.

``sources``    readers, writers and the tables the queries run on
``functions``  column expressions
``operators``  reusable DataFrame -> DataFrame building blocks
``plans``      the composite domain pipelines
``queries``    one registered query per operator, with its SQL twin

Functions of this package that run in Python workers travel with the job, by value, so that
executors need neither the package nor the driver's path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
