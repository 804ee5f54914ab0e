"""assayer: data validation, profiling, association, split, forecasting and evaluation on Spark DataFrames."""
