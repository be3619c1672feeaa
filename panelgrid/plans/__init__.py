"""Registered queries over the bench tables, each next to its SQL twin."""
