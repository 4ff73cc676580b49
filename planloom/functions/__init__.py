"""Part of planloom; see README.md."""
