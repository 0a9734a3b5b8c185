"""strata: Spark-native tabular profiling, preparation and modelling.

Every operator takes and returns Spark DataFrames (or Spark ML objects); the
work runs as DataFrame/SQL/ML jobs.  Report records are small long-form
DataFrames (one row per column / metric / candidate).
"""

__version__ = "0.1.0"
