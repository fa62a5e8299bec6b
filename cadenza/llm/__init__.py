"""Training-data operators: mixing, filtering, deduplication, redaction, packing and formatting.

Nothing else in the library imports this subpackage.
"""

import cadenza
from pyspark import cloudpickle

# Functions sent to executors travel with their code, so workers need no import path to this package.
cloudpickle.register_pickle_by_value(cadenza)
