"""strandline: a Spark-native engine for short-read resequencing data and its neighbours."""
