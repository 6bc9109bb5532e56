"""quire: a Spark-native engine for page-oriented documents."""
