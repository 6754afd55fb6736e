"""Part of tracewell."""
