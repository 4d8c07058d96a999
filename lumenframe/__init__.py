"""Spark-first analytics over numeric feature spaces, plus training-data operators in ``lumenframe.llm``."""
