"""See README.md: operators."""
