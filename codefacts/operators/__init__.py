"""Relational operators on facts, rules and stores."""
