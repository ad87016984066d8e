"""trellis — rollout, reward and long-context evaluation analytics on Spark.

Operators are plain functions ``DataFrame -> DataFrame`` or ``Column -> Column``
that compile to native Spark expressions wherever possible.
"""

__version__ = "0.1.0"
