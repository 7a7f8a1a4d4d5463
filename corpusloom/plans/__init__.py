"""All queries of the library by group."""

from . import analytics_queries, io_queries, record_queries, retrieval_queries, table_queries, text_queries

ALL = [text_queries.R, analytics_queries.R, retrieval_queries.R, table_queries.R, io_queries.R, record_queries.R]
