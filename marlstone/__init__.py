"""marlstone: document analytics as Spark DataFrames."""
