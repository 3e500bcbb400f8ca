"""Registered queries by area; the catalogue gathers them."""
