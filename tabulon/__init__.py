"""tabulon — survey-style tabular analytics as lazy Spark DataFrame operators.

Every operator takes a DataFrame plus column names and returns a DataFrame
(or a fitted ``pyspark.ml`` model).  Nothing is collected to the driver
except bounded metadata (split points, category levels, model parameters).
"""

from pyspark import cloudpickle as _cloudpickle

from tabulon.session import checkpoint_dir, cut_lineage, get_spark

# UDF and applyInPandas bodies are pickled by value, so executors need no
# installed copy of this package.
_cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage"]
