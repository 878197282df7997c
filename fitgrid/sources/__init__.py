"""Readers that turn stored payloads into typed tables, and idempotent sinks."""
