"""Labour-market and learner analytics as plain ``DataFrame -> DataFrame`` operators on Spark."""
