"""Point-in-time-correct windowed features over events with two timestamps, on Spark DataFrames."""
