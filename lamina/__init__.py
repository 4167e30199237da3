"""A PySpark-native engine for deduplicating, versioned data sets."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors whole, so no node needs an installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def build_info() -> dict[str, str]:
    """Versions of this package and of what it runs on."""
    import platform

    import pyarrow
    import pyspark

    return {"lamina": __version__, "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "python": platform.python_version(), "system": platform.platform()}
