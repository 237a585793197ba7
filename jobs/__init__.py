"""Runnable jobs over the given tables; run them as ``python -m jobs.<name>``."""
