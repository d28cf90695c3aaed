"""The corpus tables."""

from __future__ import annotations

SOURCES = "id long, kind string, name string, collection string, origin_uri string, content_hash string, status string, detail string, created_at timestamp, updated_at timestamp"
NODES = "id long, source_id long, kind string, name string, collection string, status string, path string, uri string, mime_type string, size_bytes long, role string, content string, blob_ref string, created_at timestamp, updated_at timestamp"
CHUNKS = "id long, node_id long, source_id long, kind string, name string, collection string, status string, uri string, path string, ord int, heading_path array<string>, content string, token_count int, context string"
#: Vectors of chunks, by the chunk's id; or why there is none.
VECTORS = "id long, source_id long, kind string, name string, collection string, status string, embedding array<float>, embed_error string, cell int"
#: Terms of chunks with their places, by the chunk's id and its block; and the most places that a chunk of a block has.
POSTINGS = "term string, block long, id long, source_id long, kind string, name string, collection string, status string, positions array<int>"
BOUNDS = "term string, block long, kind string, name string, collection string, status string, most int"
#: Ids of the nodes whose content has a trigram, by blocks of ids; those of nodes that went may stay.
GRAMS = "gram string, block long, ids array<long>"
SKILLS = "source_id long, name string, description string, allowed_tools array<string>, compatibility string, license string, metadata string"
CHANGES = "version long, uri string, change string, committed_at timestamp"

TABLES = {"sources": SOURCES, "nodes": NODES, "chunks": CHUNKS, "skills": SKILLS, "vectors": VECTORS, "postings": POSTINGS, "bounds": BOUNDS, "grams": GRAMS}
#: The column that names a row's source.
KEYS = {"sources": "id"} | {t: "source_id" for t in TABLES if t not in ("sources", "bounds", "grams")}
#: The order that a table is written in, so that scans leave out what a condition on these can't meet.
ORDERS = {"nodes": ["id"], "chunks": ["id"], "postings": ["term", "block"], "bounds": ["term", "block"], "grams": ["gram", "block"]}
#: Tables whose ids are numbered.
IDS = ("sources", "nodes", "chunks")
#: The layout of the store; older ones must be migrated.
SCHEMA = 3
KINDS = ("skill", "doc")
STATUSES = ("ready", "needs_ocr", "failed")
ROLES = ("skill_md", "reference", "script", "asset", "doc")
#: Of documents that name none.
COLLECTION = "default"
