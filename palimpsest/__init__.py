"""palimpsest: a Spark-native engine for long conversation and event histories."""
