"""emberframe: thermal-anomaly analytics over gridded satellite observations, as PySpark DataFrame operators."""
