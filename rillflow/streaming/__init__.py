"""The jobs as streams: file sources, stateful processors and idempotent sinks."""
