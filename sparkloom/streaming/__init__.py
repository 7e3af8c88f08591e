"""Fitted models over streams."""
