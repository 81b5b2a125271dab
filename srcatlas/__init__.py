"""srcatlas: search, navigation, history and corpus operators for source collections on Spark DataFrames."""
