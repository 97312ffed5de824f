"""Readers of captured pages, payloads and exports, and writers."""
