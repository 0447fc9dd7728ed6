"""Deferred plans over named collections."""

from keyfold.plans.collection import Collection
from keyfold.plans.dag import Dag
from keyfold.plans.pipeline import Pipeline

__all__ = ["Collection", "Dag", "Pipeline"]
