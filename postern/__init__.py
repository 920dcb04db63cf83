"""Mail-evidence analytics on Spark: scans, text and URL functions, scoring, correlation, intelligence joins."""
