"""Fixed schemas of the relations (T1-T20); nothing is inferred."""

from __future__ import annotations

CHUNKS = "chunk_id string, length long, data binary"
FILES = "file_id string, size long"
FILE_CHUNKS = "file_id string, seq int, chunk_id string, offset long, length long"
MANIFEST = "path string, file_id string, size long"
MANIFEST_ENTRIES = f"manifest_id string, {MANIFEST}"
VERSIONS = "version_id string, manifest_id string, parents array<string>, author string, time timestamp, expiry timestamp, graph_id string, message string"
GRAPH_EDGES = "graph_id string, source string, target string, type string"
GRAPH_EXTRACTORS = "graph_id string, name string, version string, scope string"
SIGNATURES = "signature_id string, version_id string, key string, signature binary"
OBJECTS = "kind string, digest string, size long, modified timestamp, data binary"
REFS = "scope string, name string, version_id string"
LOCKS = "path string, owner string, since timestamp, reason string, broken_from string, broken_at timestamp"
SETTINGS = "locking boolean, lock_expiry_seconds long"
CACHE = "path string, mtime_ns long, size long, file_id string"
SCAN = "path string, size long, mtime_ns long"
TIMELINE = "ref_name string, version_id string, time timestamp, expiry timestamp"
CHANGES = "kind string, path_before string, path_after string, file_before string, file_after string, size_before long, size_after long"
CONFLICTS = "path string, kind string, ours_file string, ours_size long, theirs_file string, theirs_size long"
CLEAR_CHECK = "path string, verdict string, reason string, bytes long"
