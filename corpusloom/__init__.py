"""corpusloom: text-corpus analytics on PySpark DataFrames."""
