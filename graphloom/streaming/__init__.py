"""Change-log parsing and incremental application in Structured Streaming."""
