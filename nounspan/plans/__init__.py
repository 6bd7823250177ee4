"""End-to-end jobs, from input tables to output tables."""
