"""Row-local stages on streams of files."""
