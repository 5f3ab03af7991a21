"""Region analytics over very large images, on Spark DataFrames."""
