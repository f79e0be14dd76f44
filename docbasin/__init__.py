"""docbasin: search, analysis and table work over collections of documents, on Spark DataFrames."""
