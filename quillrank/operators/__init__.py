"""Operators: functions from DataFrames to DataFrames. Long tables throughout: hits (query_id, doc_id, score), edges
(doc_id, citation, pos), scores (query_id, citation, score), gold (query_id, citation)."""
