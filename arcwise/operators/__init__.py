"""Relational and grouped-map operators on networks."""
