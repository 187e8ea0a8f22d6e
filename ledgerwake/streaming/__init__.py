"""The replay over a stream of periods."""
