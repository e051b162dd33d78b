"""Training-data operators: ten dealt components, their queries and the corpus pipeline's parts.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
