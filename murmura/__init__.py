"""Spark DataFrame operators for word counts, number summaries, user-corrected
ratings and clustering.  Every operator takes and returns DataFrames."""
