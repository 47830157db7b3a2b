"""graphloom: a Spark-native engine for building and scoring knowledge graphs from text."""
