"""Explicit schemas of landed files and derived tables; nothing is inferred."""

from __future__ import annotations

KEY = "struct<fingerprint: binary, text: string, type: string, canonical: string>"

#: One row per scan of an account: the append-only source of truth.
SCANS = "account_id long, node_id string, login string, scan_id string, observed_at timestamp, status string, keys array<long>"

LISTING_PAGES = "page long, objects array<struct<id: long, node_id: string, login: string, type: string>>, next_url string, _corrupt_record string"

SEARCH_PAGES = "partition long, page long, total_count long, incomplete_results boolean, items array<struct<id: long, node_id: string, login: string, type: string>>, _corrupt_record string"

RESPONSES = """batch long, position int, requested_id long, requested_node_id string,
  node struct<__typename: string, id: string, databaseId: long, login: string, createdAt: timestamp,
    publicKeys: struct<totalCount: int, pageInfo: struct<hasNextPage: boolean, endCursor: string>,
      nodes: array<struct<key: string, fingerprint: string>>>>, _corrupt_record string"""
