"""veriframe: audit and reconciliation analytics as PySpark DataFrame functions."""
