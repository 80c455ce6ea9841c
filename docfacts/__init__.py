"""docfacts: labelled-fact extraction, review, learning and exports as Spark DataFrames."""
