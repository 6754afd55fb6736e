"""tracewell: a Spark-first analytics engine for recordings held as arrays, events and labels."""
