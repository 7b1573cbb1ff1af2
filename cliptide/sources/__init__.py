"""Readers and writers for questions, memories, subtitles, captions and run logs."""
