"""ledgerloom: receivable reconciliation and ledger analytics as plain PySpark pipelines."""
