"""normspark: analytics for detectors that learn from normal data only, built on Spark DataFrames."""
