"""peakscreen: DataFrame-native screening of chromatography peak tables on Spark.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects (or Catalyst
``Column`` expressions) and takes its column names and rule maps as parameters,
so the same code runs on instrument exports and on any table with identifiers,
categories, measurements and labels.
"""

from peakscreen.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
