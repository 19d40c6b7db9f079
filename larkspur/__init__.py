"""larkspur: log analytics and training-data preparation written as Spark DataFrame programs."""
