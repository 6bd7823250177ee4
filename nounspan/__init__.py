"""Spark-native toolkit for datasets on gendered noun forms in translation.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns.  Python workers run only where a caller plugs in a model: a
translator, a judge, a tagger.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that go to Python workers carry their code with them, so that
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
