"""Part of sedge; see README."""
