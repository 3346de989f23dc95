"""See README.md: functions."""
