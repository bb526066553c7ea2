"""tillroll: retail invoice-line analytics on Spark DataFrames.

Subpackages:
  sources    -- invoice CSV ingestion, the test-table view, result sinks
  functions  -- column expressions and small numeric finalisers
  operators  -- cleaning, key figures, distributions, inference, time series,
                customers, clustering, exact order statistics
  plans      -- the registered report queries and their SQL oracles
"""

__version__ = "0.1.0"
