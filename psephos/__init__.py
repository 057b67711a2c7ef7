"""Election tabulation analytics on PySpark DataFrames."""
