"""Approximate analytics on Spark: samples, sketches and their exact counterparts."""

from plumbline.spec import AggregateSpec, Comparison

__all__ = ["AggregateSpec", "Comparison"]
