"""Training-data operators: leakage, duplicates, splitting, packing, labelling.

Nothing outside this subpackage imports it.
"""
