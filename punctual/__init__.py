"""punctual — on-time-performance analytics as PySpark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` and is
expressed with built-in Spark SQL functions so Catalyst can push filters and
column pruning into the scan and keep the work inside whole-stage codegen.
"""

from punctual.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
