"""Registered queries: each operator over whole tables, beside equivalent SQL."""
