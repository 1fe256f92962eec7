"""Part of tallywork."""
