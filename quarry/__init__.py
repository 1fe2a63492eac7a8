"""quarry: a document retrieval and corpus engine expressed in PySpark DataFrames."""
