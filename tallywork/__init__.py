"""tallywork: ledger analytics and corpus preparation as PySpark DataFrame programs."""
