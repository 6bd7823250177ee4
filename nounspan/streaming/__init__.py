"""Incremental runs.  Inputs are whole files, so a run resumes by key."""
