"""tripmart: trip-data cleaning and summary marts on Spark DataFrames.

Layout: ``sources`` (CSV / Parquet in and out), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame steps), ``plans`` (the
marts and the query registry), ``streaming`` (incremental landing).
"""

from tripmart.operators.clean import R, SQL, Profile, clean_trips

__all__ = ["R", "SQL", "Profile", "clean_trips"]
