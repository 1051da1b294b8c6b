"""tidewright: daily time-series analytics and probabilistic-forecast evaluation on Spark."""
