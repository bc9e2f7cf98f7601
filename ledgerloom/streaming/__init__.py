"""Structured Streaming forms of the gate, the resolver and the alerts."""
