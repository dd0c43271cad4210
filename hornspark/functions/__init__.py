"""Functions by name: how to type a call and how to build its column. All stay in the JVM."""

from hornspark.functions import compound, scalar, temporal
from hornspark.functions.registry import FUNCTIONS, apply

__all__ = ["FUNCTIONS", "apply", "compound", "scalar", "temporal"]
