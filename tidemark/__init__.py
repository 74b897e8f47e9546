"""Service-level analytics on Spark, and operations of a training-data pipeline in the subpackage ``llm``."""
