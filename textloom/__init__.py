"""textloom: text analytics on DataFrames of documents."""

__version__ = "0.1.0"
