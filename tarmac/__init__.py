"""tarmac: batch analytics over incident-like event tables, written for Spark."""
