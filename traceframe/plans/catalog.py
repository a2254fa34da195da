"""All registered queries; importing the query modules fills the registry."""

from traceframe.plans import check_queries, compare_queries, geometry_queries, label_queries  # noqa: F401
from traceframe.plans import run_queries, shape_queries, source_queries, stream_queries, word_queries  # noqa: F401
from traceframe.plans.registry import QUERIES, SQL  # noqa: F401
