"""End-to-end jobs that chain operators through stored stage tables."""
