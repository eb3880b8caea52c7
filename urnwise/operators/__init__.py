"""Operators on draws: descriptive, features, hypotheses, bank, tickets, covering, validation, diagnostics, learning."""
