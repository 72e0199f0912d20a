"""Readers and writers: files, typed tables, the sample layout and run logs."""
