"""Projections of package and project payloads onto one common record."""
