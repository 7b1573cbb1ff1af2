"""Structured Streaming operators over ordered clip streams."""
