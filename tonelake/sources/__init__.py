"""Readers and writers: containers, packet corpora, raw samples."""
