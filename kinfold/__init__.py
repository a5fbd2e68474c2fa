"""kinfold: a Spark-native similarity, entity-resolution and gallery engine."""
