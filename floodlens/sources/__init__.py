"""Readers for text, JSON and capture inputs, and the result sinks.

Each reader is a file scan followed by a parse function over a DataFrame of lines, so the parse
also works on lines that come from elsewhere.
"""
