"""tabulon: a Spark-native engine for additive count cubes, rule checks and ordered-log analytics."""
