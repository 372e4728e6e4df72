"""Explicit schemas: posts as they come in, commits and the change log."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, A = T.StringType(), T.LongType(), T.ArrayType


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


IMAGE = struct(fullsize=S, thumb=S, alt=S, aspectRatio=struct(width=T.DoubleType(), height=T.DoubleType()))
EXTERNAL = struct(uri=S, title=S, description=S)
RECORD = struct(type=S, uri=S, authorDid=S, authorHandle=S)
MEDIA = struct(type=S, images=A(IMAGE), external=EXTERNAL)
EMBED = struct(type=S, images=A(IMAGE), external=EXTERNAL, record=RECORD, media=MEDIA, rawType=S, data=S)
FACET = struct(features=A(struct(type=S, did=S, uri=S, tag=S)))
REPLY = struct(root=struct(uri=S, cid=S), parent=struct(uri=S, cid=S))
#: Kept as they come, since a count that is text or has a fraction is told from a number without.
METRICS = T.VariantType()
REASON = struct(type=S, byDid=S, byHandle=S)
RAW_POST = struct(
    uri=S, cid=S, author=S, authorDid=S, indexedAt=S, metrics=METRICS, embed=EMBED, feed=struct(reason=REASON),
    record=struct(text=S, createdAt=S, facets=A(FACET), reply=REPLY, embed=S, langs=A(S), tags=A(S)),
)
POST = struct(
    uri=S, author=S, authorDid=S, text=S, createdAt=S, hashtags=A(S), mentions=A(S), mentionDids=A(S), links=A(S), langs=A(S), metrics=METRICS, reply=REPLY, embed=EMBED, feed=struct(reason=REASON),
)
#: A line of any shape: the fields of raw and of normalised posts, and of posts with their store.
LINE = T.StructType(list({f.name: f for s in (POST, RAW_POST, struct(store=S, post=POST)) for f in s}.values()))
STORED_POST = struct(store=S, post=POST)
COMMIT = struct(did=S, time_us=L, kind=S, commit=struct(operation=S, collection=S, rkey=S, cid=S, record=struct(text=S, createdAt=S, langs=A(S))))
LOG = struct(seq=L, op=S, uri=S, author=S, author_did=S, event_type=S, hashtags=A(S), text=S, like_count=L, source=S, source_store=S)
