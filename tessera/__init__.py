"""tessera: a PySpark-native analytics library.

Star-schema loads and analytic reports, spatial joins, cleaning and
profiling jobs, rating bias models and a modelling layer, all written as
functions from DataFrames to DataFrames whose core work runs on Spark SQL
and MLlib.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions that run in Python workers (Arrow-batched hull, kNN block kernel, ring
    clipping) are pickled by value, so executors need no installed copy of the package
    and the driver may import it from any folder."""
    import sys

    try:
        from pyspark import cloudpickle
    except Exception:  # pragma: no cover - pyspark without its bundled cloudpickle
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
