"""Operators for preparing training data: each module holds one and its query."""
