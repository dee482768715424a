"""Readers and writers for network, trips, parameter and state files."""
