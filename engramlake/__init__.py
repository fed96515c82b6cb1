"""engramlake: conversational-memory analytics as Spark DataFrame operators."""
