"""Tables, logs, sorted runs and manifests as Spark sources and sinks."""
