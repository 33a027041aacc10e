"""Readers of code, documentation, compile databases and suppression files."""
