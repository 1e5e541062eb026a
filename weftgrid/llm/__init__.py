"""Operators for preparing training text, their queries and the SQL they are checked against.

Nothing else in the library imports this subpackage.  Its functions travel to the workers with the query, so
executors need the public libraries only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
