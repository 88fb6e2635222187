"""gaugeframe: Spark-native auditing of scalar reasoning scores, and training-data operators (llm)."""
