"""Product-usage analytics on Spark: event detail, daily summaries, metrics."""
