"""Registered queries: each operator on the given tables, with an independent SQL check."""

from barsmith.plans.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
