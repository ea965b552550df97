"""Readers, landing jobs and index upkeep."""
