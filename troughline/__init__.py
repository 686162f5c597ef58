"""PySpark library for batch work on patient, dose and drug-concentration tables."""
