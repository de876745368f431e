"""pagewright: a Spark-native corpus analytics and hybrid-retrieval engine."""
