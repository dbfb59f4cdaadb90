"""Column expressions: keys, dates, geometry and text rules. No Python workers."""
