"""Training-data operators: archives, deduplication, token files, scans, scoring and language ID.

The subpackage stands alone: nothing outside it imports it, and it imports nothing from the rest of the library.
"""
