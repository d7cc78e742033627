"""flatsieve: flat-file scanning, filtering, aggregation and validation on Spark."""

from .api import *  # noqa: F403
from .api import __all__  # noqa: F401
