"""Search operators over DataFrames of vectors."""
