"""Relations over pages: thresholds, neighbourhoods, metrics, codecs."""
