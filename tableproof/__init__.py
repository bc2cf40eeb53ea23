"""Prove that two versions of a table estate hold the same data, on Spark."""

from tableproof.target import FK, SampleSpec, Target

__all__ = ["FK", "SampleSpec", "Target"]
