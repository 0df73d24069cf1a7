"""Typed schemas of the eight entity tables (S1) and their column defaults.

Ids are typed by the caller: the application uses uuid text, the test
fixtures use bigint. ``entity_schema(name, id_type)`` builds either.
"""

from __future__ import annotations

from pyspark.sql import types as T

_ID = "__id__"

# column name -> (type or _ID placeholder, nullable)
_TABLES: dict[str, list[tuple[str, object, bool]]] = {
    "users": [
        ("id", _ID, False), ("email", T.StringType(), False), ("name", T.StringType(), False),
        ("created_at", T.TimestampNTZType(), True), ("updated_at", T.TimestampNTZType(), True),
    ],
    "workspaces": [
        ("id", _ID, False), ("name", T.StringType(), False),
        ("created_at", T.TimestampNTZType(), True), ("updated_at", T.TimestampNTZType(), True),
        ("deleted_at", T.TimestampNTZType(), True),
    ],
    "memberships": [
        ("workspace_id", _ID, False), ("user_id", _ID, False), ("role", T.StringType(), False),
        ("joined_at", T.TimestampNTZType(), True),
    ],
    "workspace_invites": [
        ("id", _ID, False), ("workspace_id", _ID, False), ("created_by", _ID, True),
        ("token", T.StringType(), False), ("max_uses", T.IntegerType(), False),
        ("use_count", T.IntegerType(), False), ("expires_at", T.TimestampNTZType(), False),
        ("created_at", T.TimestampNTZType(), True),
    ],
    "clients": [
        ("id", _ID, False), ("workspace_id", _ID, False), ("name", T.StringType(), False),
        ("social_handles", T.MapType(T.StringType(), T.StringType()), False),
        ("notes", T.StringType(), False), ("active", T.BooleanType(), False),
        ("created_at", T.TimestampNTZType(), True), ("updated_at", T.TimestampNTZType(), True),
        ("deleted_at", T.TimestampNTZType(), True),
    ],
    "content_items": [
        ("id", _ID, False), ("workspace_id", _ID, False), ("client_id", _ID, True),
        ("title", T.StringType(), False), ("description", T.StringType(), False),
        ("platform", T.StringType(), False), ("content_type", T.StringType(), False),
        ("status", T.StringType(), False), ("scheduled_date", T.DateType(), True),
        ("created_by", _ID, True), ("created_at", T.TimestampNTZType(), True),
        ("updated_at", T.TimestampNTZType(), True),
    ],
    "comments": [
        ("id", _ID, False), ("content_item_id", _ID, False), ("author_id", _ID, True),
        ("body", T.StringType(), False), ("created_at", T.TimestampNTZType(), True),
    ],
    "tasks": [
        ("id", _ID, False), ("workspace_id", _ID, False), ("title", T.StringType(), False),
        ("description", T.StringType(), False), ("assignee_id", _ID, True),
        ("due_date", T.DateType(), True), ("done", T.BooleanType(), False),
        ("content_item_id", _ID, True), ("client_id", _ID, True),
        ("created_at", T.TimestampNTZType(), True), ("updated_at", T.TimestampNTZType(), True),
    ],
}

# Column defaults applied on ingest (S2). FIXED VALUES of the data model.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"name": ""},
    "memberships": {"role": "viewer"},
    "workspace_invites": {"max_uses": 10, "use_count": 0},
    "clients": {"notes": "", "active": True},
    "content_items": {"description": "", "platform": "other", "content_type": "post", "status": "draft"},
    "tasks": {"description": "", "done": False},
}

TABLE_NAMES = list(_TABLES)


def entity_schema(name: str, id_type: T.DataType = T.StringType()) -> T.StructType:
    fields = []
    for col, typ, nullable in _TABLES[name]:
        fields.append(T.StructField(col, id_type if typ is _ID else typ, nullable))
    return T.StructType(fields)
