"""Readers of record payloads and stored versions."""
