"""Dialogue and text-cohesion analytics expressed as Spark plans."""
