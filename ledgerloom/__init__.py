"""ledgerloom: dual-layer ledger and network analytics on Spark DataFrames."""
