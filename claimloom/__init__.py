"""claimloom: claim extraction, consistency rules and support diagnostics on Spark DataFrames."""
