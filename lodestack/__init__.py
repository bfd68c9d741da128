"""lodestack: ranking, linking and searching large catalogues with PySpark DataFrames."""

__version__ = "0.1.0"
