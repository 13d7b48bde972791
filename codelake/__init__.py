"""codelake: a Spark-native engine for structured source text and relational analytics."""
