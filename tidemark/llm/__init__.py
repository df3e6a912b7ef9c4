"""Operators for preparing training text: quality, search, scoring, secrets, mixing, copies, tokens, packing, pages."""
