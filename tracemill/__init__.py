"""Event-log analytics on Spark: traces, partitions, encodings and metrics as DataFrame operators."""
