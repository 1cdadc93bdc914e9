"""A PySpark engine for situational retrieval over a corpus of historical passages."""
