"""Imports every module that registers queries."""

from voltspan.plans import details, extras, feeds, formats, packs, places, pyramids, relations, scalars, selections  # noqa: F401
from voltspan.plans.registry import FLAGSHIP, ORACLES, QUERIES  # noqa: F401
