"""Analytics over bibliographic and text records, expressed in Spark DataFrames."""
