"""quantloom: a Spark-first engine for ordered event data (tick tapes, bars, features, signals, evaluation)."""
