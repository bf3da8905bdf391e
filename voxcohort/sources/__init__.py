"""Readers and writers for cohort files."""
