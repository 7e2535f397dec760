"""cellframe: battery-cycler telemetry analytics on Spark DataFrames."""
