"""Loading records from JSON layers, tables and a generator."""
