"""A Spark-native engine for curating code-completion corpora."""
