"""Operators for training-text preparation. Nothing outside this folder imports it."""
