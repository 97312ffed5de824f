"""Stateful operators over streams of captured events."""
