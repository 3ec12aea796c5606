"""Stored tables and exports."""
