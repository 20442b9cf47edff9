"""Text scoring, grading and data preparation on Spark DataFrames."""
