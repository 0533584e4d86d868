"""Readers and writers of daily measurements."""
