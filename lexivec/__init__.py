"""lexivec: text, vector and evaluation analytics as Spark DataFrame plans."""
