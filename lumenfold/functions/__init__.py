"""Scalar rules: geometry, selections, settings, text of reports."""
