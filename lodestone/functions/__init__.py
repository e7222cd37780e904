"""Column functions: everything here is an expression over one row."""
