"""Training-data pipeline operators (token counts, filters, dedup, packing, ...).

Nothing outside this subpackage imports it; deleting the folder leaves the rest
of the library working.
"""
