"""Topic readers, record decoding, and routing of logs and change records."""
