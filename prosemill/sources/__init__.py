"""Readers and writers: line-aligned pairs, JSON lines, checkpoints, newest files, exports."""
