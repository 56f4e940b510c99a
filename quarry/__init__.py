"""quarry: a Spark-native engine for retrieval, learning analytics and corpus preparation."""
