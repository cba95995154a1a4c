"""Runnable jobs over growing tables; each has a command line and a JSON config beside it."""
