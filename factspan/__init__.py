"""Configuration facts and training-text operators as Spark plans."""
