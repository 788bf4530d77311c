"""Registered traffic queries and their SQL."""

from __future__ import annotations

from tideway.plans import documents, lanes, network, snapshots, traffic

QUERIES = {**traffic.QUERIES, **documents.QUERIES, **lanes.QUERIES, **network.QUERIES, **snapshots.QUERIES}
ORACLES = {**traffic.ORACLES, **documents.ORACLES, **lanes.ORACLES, **network.ORACLES, **snapshots.ORACLES}
