"""The query catalogue and its SQL."""

from wakeline.plans import catalogue, more, oracles  # noqa: F401
