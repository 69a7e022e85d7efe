"""Graph and mining operators over DataFrames."""
