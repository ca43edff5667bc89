"""tallywright: Spark-first analytics over evaluation samples, rollouts and training text."""
