"""Sources, intake checks and sinks."""
