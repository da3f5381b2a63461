"""Table scans, prediction archives and sinks."""
