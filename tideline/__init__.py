"""tideline: a Spark-first engine for walk-forward panel analytics."""
