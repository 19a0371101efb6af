"""Training-data operators: near duplicates, decontamination, mixing, filters, search and output.

Nothing outside this subpackage imports it.
"""
