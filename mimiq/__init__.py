"""Analytics over frame-by-frame facial-behaviour tables, as Spark DataFrames."""
