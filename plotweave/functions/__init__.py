"""Column functions. No Python UDF lives here."""
