"""Readers and writers of packet formats."""
