"""tidefold: keyed state over operation logs, as Spark DataFrames."""
