"""Part of sparkwell."""
