"""Intentionally empty: this engine's operators are all batch (there is no streaming operator to match)."""
