"""Software-evolution analytics as Spark DataFrame operators."""
