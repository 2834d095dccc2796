"""Operators over knowledge entries, file manifests, commits and model replies."""
