"""allelica: population-genetic analytics on Spark DataFrames."""
