"""Training-data operators: tokenising, formatting, de-duplication, scoring and packing.

Nothing outside this subpackage imports it.  Every operator selects the columns it needs by
parameter, so extra columns (also ones that share a name with an output) never reach it.
"""
