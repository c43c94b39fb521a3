"""Training-data operators over document tables.

Nothing outside this subpackage imports it. Every operator reads only the
columns it names, so extra columns of any name pass through or are ignored.
"""

import sys

from pyspark import cloudpickle

# Executors get these functions by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
