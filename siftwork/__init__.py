"""siftwork: Spark-native evaluation of literature-search strategies.

Layout: ``functions`` (column expressions), ``sources`` (readers and
writers), ``operators`` (DataFrame -> DataFrame steps), ``plans`` (end-to-end
plans over the driver tables and their oracle SQL), ``streaming``
(incremental ingestion of landed result files).
"""

__version__ = "0.1.0"
