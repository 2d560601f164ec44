"""Spark-native retrieval analytics engine."""


def ship(name: str) -> None:
    """Lets tasks have a module's functions by value, so that workers need no copy of the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[name])
