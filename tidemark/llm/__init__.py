"""Operations of a training-data pipeline. Nothing outside this subpackage imports it but the entry module."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
