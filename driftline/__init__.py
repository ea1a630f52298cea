"""Analytics over tables whose schemas change, on Spark DataFrames."""
