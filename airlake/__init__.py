"""airlake: batch analytics operators for sensor, imagery and text tables on Spark DataFrames."""
