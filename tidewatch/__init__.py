"""tidewatch - geo-social post analytics as PySpark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
lazily planned DataFrame; nothing is collected to the driver.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship this package's Python helpers (Arrow UDF bodies) by value with each task, so
# executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from tidewatch.session import get_spark, checkpoint_dir  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir"]
