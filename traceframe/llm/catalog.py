"""All corpus queries; importing the query modules fills the registry."""

from traceframe.llm import classifier_queries, conversations_queries, decontaminate_queries, language_queries, licenses_queries, negatives_queries, neardup_queries, packing_queries, rules_queries, suffixes_queries, units_queries, urls_queries, warc_queries  # noqa: F401
from traceframe.llm.registry import QUERIES, SQL  # noqa: F401
