"""siltgate: text, message and change-set policy analytics as Spark DataFrames."""
