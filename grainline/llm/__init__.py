"""Training-data pipeline operators (corpus cleaning, search, archives).

Nothing else in the library imports this subpackage."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this subpackage travel to the executors by value, so jobs do
# not need the repository on the workers' path.
register_pickle_by_value(sys.modules[__name__])
