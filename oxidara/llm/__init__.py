"""Training-data operators: search, deduplication, scoring, tokenizing and packing.

Nothing outside this subpackage imports it.  Each module holds one operator; ``registry`` holds
the thin queries ``opN_<name>`` and their SQL.
"""
