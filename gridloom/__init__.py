"""gridloom: space-time cube analytics expressed as ordinary Spark DataFrames."""
