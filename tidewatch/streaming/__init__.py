"""Streaming forms of rules, for alerts while data arrives."""
