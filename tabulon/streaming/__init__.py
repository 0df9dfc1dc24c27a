"""Structured Streaming: state of watched items, and counts of events in windows with late data."""
