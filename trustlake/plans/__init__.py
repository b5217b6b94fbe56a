"""Pipelines and the control plane."""
