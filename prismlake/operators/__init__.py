"""Block transforms, codecs, merges, metrics and size searches over DataFrames."""
