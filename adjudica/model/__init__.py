"""Claim tables: their schemas, and the mapping of order tables onto them."""
