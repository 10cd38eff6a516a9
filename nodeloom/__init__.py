"""nodeloom: a property-graph query and data-processing engine on Spark DataFrames."""
