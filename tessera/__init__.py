"""An analytics engine on PySpark: a thin layer over DataFrames, Spark SQL and Catalyst."""
