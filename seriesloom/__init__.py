"""Panel forecasting and retrieval analytics as plain DataFrame functions."""

import sys

from pyspark import cloudpickle

# the few Python task functions travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
