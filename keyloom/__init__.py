"""keyloom: Spark-native operators for keyed data, overlays, sketches, codes and event streams."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions of ours travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
