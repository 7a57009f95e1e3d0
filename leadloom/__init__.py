"""Leadloom: a PySpark engine for lead data, with training-data operators in ``leadloom.llm``."""
