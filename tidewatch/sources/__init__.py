"""Readers and writers of raw transaction data."""
