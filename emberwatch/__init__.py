"""Log threat analytics as Spark DataFrame plans: parse, detect, correlate, reconcile, notify."""

from emberwatch.model import ChainConfig, DetectConfig

__all__ = ["ChainConfig", "DetectConfig"]
