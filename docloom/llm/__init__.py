"""Training-data operators: the ten corpus operators and their queries.

Nothing outside this package imports it; deleting the folder leaves the rest of the library whole.
"""
