"""Message and document forensics as Spark plans: DataFrames in, DataFrames out."""
