"""Retention and reclaim analytics on Spark.

Inventories, listings and logs arrive as DataFrames; retention rules are Spark
``Column`` expressions; the output is a plan table (which rows a rule would drop)
and a report of files and bytes per rule.  Nothing is deleted anywhere.
"""

from reclaim.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
