"""The registered queries with their SQL twins."""

from bellwire.registry import aggregates, models, news, streams, tables

ENTRIES = {**tables.ENTRIES, **news.ENTRIES, **aggregates.ENTRIES, **models.ENTRIES, **streams.ENTRIES}
