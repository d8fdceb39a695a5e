"""Registered queries, their SQL, and the comparison of both."""
