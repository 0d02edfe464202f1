"""Archive dataflows on Spark: entries, filters, policies, encoders, selection, accounting and ZIP files."""
