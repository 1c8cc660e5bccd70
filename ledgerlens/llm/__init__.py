"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; ``queries`` holds the thin queries over the given
tables and their SQL.
"""
