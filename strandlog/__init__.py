"""An append-only event log engine on Spark DataFrames, with training-data operators in strandlog.llm."""
