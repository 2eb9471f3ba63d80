"""Analytics over dated personal writing, its notes, links, metrics and vectors, on Spark DataFrames."""
