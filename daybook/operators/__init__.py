"""DataFrame operators: derivations, detail and summary tables, metrics, checks."""
