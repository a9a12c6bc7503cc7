"""The query catalogue: importing this package registers every query and its check text."""

from cilens.plans.registry import ORACLES, QUERIES  # noqa: F401
from cilens.plans import logs, graph, localize, sources, diagnostics, records, retrieval, patches, outcomes, commerce, streams, source  # noqa: F401
