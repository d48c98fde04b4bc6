"""tallyloom: multi-source ledger reconciliation and corpus jobs on Spark DataFrames."""
