"""asofkit: point-in-time datasets, contract checks and score analytics as Spark DataFrame operators."""
