"""doorlens: property-level lead scoring over public records, as Spark jobs.

Every operator takes DataFrames and returns DataFrames. The run date is always
an argument (`as_of`), never the wall clock.
"""

__version__ = "0.1.0"
