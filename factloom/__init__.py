"""factloom: a Spark-native engine for searchable, explainable knowledge."""
