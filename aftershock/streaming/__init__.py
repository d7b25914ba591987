"""Structured Streaming entry points.

The studied analysis has no streaming; the one stream here ingests landed
company-facts documents incrementally (``facts_stream``), running the same
batch operators per micro-batch with a checkpointed file source.
"""
