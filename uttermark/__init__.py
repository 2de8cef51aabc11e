"""Speech-transcript evaluation as PySpark DataFrame operators."""
