"""lattis: structural-memory and retrieval analytics as Spark DataFrame plans."""
