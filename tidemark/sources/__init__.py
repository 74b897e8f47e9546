"""Readers and writers of telemetry and artifact tables."""
