"""editpulse: analytics over streams of page-edit events, on Spark DataFrames.

Batch and streaming share the operators in ``editpulse.operators``: each takes
DataFrames and returns a DataFrame, and leaves the physical plan to Catalyst.
"""

__version__ = "0.1.0"
