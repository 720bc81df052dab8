"""opsloom: DataFrame operators for operational data (logs, metrics, key-value state, event streams)."""
