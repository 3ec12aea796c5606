"""Readers of branch lists, stored tables and collected pages."""
