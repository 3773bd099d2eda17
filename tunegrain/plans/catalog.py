"""All registered queries."""

from tunegrain.plans import (  # noqa: F401
    certificate_queries, evaluation_queries, fact_queries, feature_queries, graph_queries, job_queries, model_queries, sampling_queries,
    segment_queries, table_queries,
)
from tunegrain.plans.registry import QUERIES  # noqa: F401
