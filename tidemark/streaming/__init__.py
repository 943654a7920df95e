"""Structured Streaming forms of the operators, stateful processors and sinks."""
