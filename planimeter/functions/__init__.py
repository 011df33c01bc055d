"""Part of planimeter."""
