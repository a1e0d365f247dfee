"""Part of percola; see the README."""
