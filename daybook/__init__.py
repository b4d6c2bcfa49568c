"""Spark jobs for ambient-speech diaries of many owners."""
