"""plumbline: evidence-audit operators over Spark DataFrames."""
