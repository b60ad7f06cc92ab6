"""sensorlake: sensor-data normalisation, profiling and analytics as Spark plans."""
