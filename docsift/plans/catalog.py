"""Imports every query module so that its queries register."""

from docsift.plans import search_queries  # noqa: F401
from docsift.plans import text_queries  # noqa: F401
from docsift.plans import request_queries  # noqa: F401
from docsift.plans import segment_queries  # noqa: F401
from docsift.plans import matching_queries  # noqa: F401
from docsift.plans import facet_queries  # noqa: F401
from docsift.plans import tag_queries  # noqa: F401
from docsift.plans import vector_queries  # noqa: F401
from docsift.plans import incremental_queries  # noqa: F401
from docsift.plans import rule_queries  # noqa: F401
from docsift.plans import scalar_queries  # noqa: F401
from docsift.plans import nlp_queries  # noqa: F401
from docsift.plans import source_queries  # noqa: F401
from docsift.plans import stream_queries  # noqa: F401
