"""Fitted steps, their composition and ensemble plans."""
