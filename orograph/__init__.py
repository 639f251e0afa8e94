"""orograph: survey-mesh and terrain analytics written for Spark DataFrames."""
