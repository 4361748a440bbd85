"""Security-log analytics on PySpark: parse, enrich, detect, correlate, score, summarise."""
