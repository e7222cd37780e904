"""Inputs and the durable store."""
