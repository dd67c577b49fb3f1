"""lumen: analytics of timed sensor observations on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark's
DataFrame, SQL and ML APIs; nothing is held in module globals.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions and closures of this package travel with each task, so Python
# workers need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from lumen.session import ensure_checkpoint_dir, get_session  # noqa: E402

__all__ = ["get_session", "ensure_checkpoint_dir"]
