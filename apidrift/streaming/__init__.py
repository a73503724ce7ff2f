"""Incremental forms: new releases against the last known one, new dependencies against known breaks."""
