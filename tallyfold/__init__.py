"""Signal fusion and training-data preparation as PySpark jobs."""
