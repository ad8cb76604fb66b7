"""tabwork: a Spark-native tabular ML workbench.

Every operator takes and returns Spark DataFrames; the heavy lifting is
expressed with DataFrame / SQL primitives so Catalyst can prune, push down
and fuse it.  See README.md for the operator map.
"""

__version__ = "0.1.0"
