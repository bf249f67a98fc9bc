"""larkmill: a Spark-native engine for document matching and corpus preparation."""
