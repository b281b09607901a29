"""Payloads of boards as listings: every parser takes a DataFrame of payloads and gives rows of RAW_JOB."""
