"""paperloom: triage, analysis records and digests for document collections, on Spark."""

from paperloom.config import Dimension, Topic, TriageConfig

__all__ = ["Dimension", "Topic", "TriageConfig"]
