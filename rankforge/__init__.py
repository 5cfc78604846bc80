"""rankforge: Spark-native operators for building and evaluating text-retrieval systems.

Every public operator takes DataFrames (plus plain parameters) and returns a lazy DataFrame.
Sub-packages:

* ``sources``   -- readers / writers and the fixture views over the driver tables
* ``functions`` -- Column-expression builders (tokenisers, n-grams, vector maths, hash keys)
* ``operators`` -- DataFrame -> DataFrame operators (cleaning, BM25, TF-IDF, search, metrics, ...)
* ``plans``     -- end-to-end flows composed from operators, and the query catalogue
* ``streaming`` -- Structured Streaming form of query scoring
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers (executors) need no install."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older pyspark without the hook
        pass


_ship_by_value()
