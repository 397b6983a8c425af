"""Part of scoreline; see README.md."""
