"""Operators over messages, conversations and exports."""
