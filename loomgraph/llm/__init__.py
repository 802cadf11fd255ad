"""Training-data operators.

Nothing outside this folder imports it.  Each module holds one operator with
its own general interface; ``queries`` registers the thin ``opN_`` queries.
"""
