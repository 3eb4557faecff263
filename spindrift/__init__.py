"""Spindrift: retrieval, ranking, evaluation and corpus analytics as Spark DataFrame operators."""
