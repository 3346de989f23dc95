"""See README.md: streaming."""
