"""Python functions that executors run."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Sends the functions and classes of a module along with the plan, so that executors need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
