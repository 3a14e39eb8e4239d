"""Operators of a training-data pipeline over documents, vectors and conversations.

One module per operator; :mod:`quarry.llm.registry` lists their queries.  The
functions that run inside Spark tasks are shipped by value, so executors need
numpy, pyarrow and the named tokenizer library, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
