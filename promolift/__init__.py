"""promolift: promotion uplift analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a function
returning a ``Column``) built from Spark's own expressions, so Catalyst sees the
whole plan: filters reach the Parquet scan, aggregations run partial before the
shuffle, and nothing passes through the driver.
"""

from promolift.schema import Filters

__all__ = ["Filters"]
__version__ = "0.1.0"
