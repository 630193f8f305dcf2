"""Analytics over append-only execution logs of restartable workflows, on Spark DataFrames."""
