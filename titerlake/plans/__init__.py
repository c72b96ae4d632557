"""Named queries over the driver's tables."""

from titerlake.plans import actions, catalog, curation, inference, passages, summaries  # noqa: F401
