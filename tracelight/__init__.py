"""Longitudinal detection surveillance on Spark DataFrames.

``sources`` reads and writes tables, ``functions`` holds column expressions,
``operators`` holds DataFrame-to-DataFrame steps and ``plans`` holds the model
jobs (design, fits, draws, checks).
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel with their code, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
