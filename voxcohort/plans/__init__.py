"""Registered queries, grouped by area; importing a module registers its queries."""
