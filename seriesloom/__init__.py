"""seriesloom: labelled time-series metrics as a Spark-first engine."""

__version__ = "0.1.0"
