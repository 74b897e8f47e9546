"""Operators on telemetry tables: series, baselines, drift, targets, alerts, fleet status, grading, audit."""
