"""See README.md: sources."""
