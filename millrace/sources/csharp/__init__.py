"""A tolerant reader of C#: declarations, statements, calls and attributes of one file at a time, in plain Python."""
