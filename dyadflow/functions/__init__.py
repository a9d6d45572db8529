"""See README.md for what this folder holds."""
