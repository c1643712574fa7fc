"""Evidence-grounded document analytics as DataFrames."""
