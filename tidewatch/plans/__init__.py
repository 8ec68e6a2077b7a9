"""Logical plans of the monitoring model: layers, rules, evaluation, features and comparison."""
