"""See README.md: plans."""
