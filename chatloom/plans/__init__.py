"""What is registered, and the same in SQL."""
