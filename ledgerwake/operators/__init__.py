"""The steps of a backtest, each a function from DataFrames to DataFrames."""
