"""Registered queries, their SQL, the whole analysis and its command line."""
