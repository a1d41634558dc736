"""Sources and sinks for block-structured savesets."""
