"""textloom: a Spark-native engine for structured text, its units and their translations."""
