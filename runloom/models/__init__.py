"""Hidden Markov models trained and decoded as Spark jobs."""
