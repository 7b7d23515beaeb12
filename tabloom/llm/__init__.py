"""Training-data operators: extraction, mixing, deduplication, search, scans and packing.

Task functions of this package are pickled by value, so executors need no copy of the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
