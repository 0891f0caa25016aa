"""Byte formats in plain Python, from their published specifications; no Spark here."""
