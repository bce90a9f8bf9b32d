"""A PySpark library for auditing large collections of source files and text."""
