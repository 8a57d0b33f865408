"""Column-level scalar helpers. Each returns a ``pyspark.sql.Column`` (JVM side, codegen'd)."""

from kestrel.functions.scalars import *  # noqa: F401,F403
from kestrel.functions.scalars import __all__  # noqa: F401
