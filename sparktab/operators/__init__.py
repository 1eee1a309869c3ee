"""Inference, mapping, the buffer and checks."""
