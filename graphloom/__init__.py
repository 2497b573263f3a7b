"""RDF graph and dataset analytics on Spark DataFrames."""
