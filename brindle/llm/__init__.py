"""Operators for preparing training text: filters, language, tokens, media, scoring and deduplication.

Nothing outside this subpackage imports it.  Every operator reads only the columns that it names and
ignores all others, so an input may carry extra columns, also such as clash with the names of results.
"""
