"""Field lists, presets and image rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import flat_summary

#: Named field lists.
PRESETS = {
    "minimal": ["uri", "author", "text", "created_at", "embed_summary"],
    "social": ["uri", "author", "text", "like_count", "repost_count", "reply_count", "quote_count", "hashtags", "embed_summary"],
    "images": ["uri", "author", "text", "created_at", "images"],
    "embeds": ["uri", "author", "text", "created_at", "embed_summary"],
    "media": ["uri", "author", "text", "created_at", "images", "embed_summary"],
    "full": ["*"],
}


def preset(name: str) -> list[str]:
    if name not in PRESETS:
        raise ValueError(f"no preset named {name!r}")
    return PRESETS[name]


def fields(text: str) -> list[str]:
    """A comma list of paths and ``@preset`` names; ``@full`` stands alone."""
    parts = [x.strip() for x in text.split(",") if x.strip()]
    if not parts:
        raise ValueError("no fields")
    if "@full" in parts and len(parts) > 1:
        raise ValueError("@full stands alone")
    return list(dict.fromkeys(f for x in parts for f in (preset(x[1:]) if x[0] == "@" else [x])))


def project(posts: DataFrame, paths: list[str]) -> DataFrame:
    """Columns by dotted path, put back as nested values.

    ``head.*`` is all of a struct's children, ``array.*.name`` one child of each element;
    several such paths of one array are merged element by element.  ``embed_summary`` is made
    of the flat columns where the posts lack it.
    """
    if any(p.split(".")[0] == "embed_summary" for p in paths) and "embed_summary" not in posts.columns:
        posts = posts.withColumn("embed_summary", flat_summary())
    if paths == ["*"]:
        return posts
    tree: dict = {}
    for path in paths:
        parts = path.split(".")
        if parts[0] == "*" or parts.count("*") > 1 or "" in parts:
            raise ValueError(f"bad path {path!r}")
        node = tree
        for part in parts:
            node = node.setdefault(part, {})
    schema = {f.name: f.dataType for f in posts.schema}
    if missing := [h for h in tree if h not in schema]:
        raise ValueError(f"no column {missing[0]!r}")
    return posts.select(*[_value(F.col(h), schema[h], below, h).alias(h) for h, below in tree.items()])


def _value(column: Column, kind: T.DataType, below: dict, path: str) -> Column:
    if not below:
        return column
    if isinstance(kind, T.ArrayType):
        if set(below) != {"*"}:
            raise ValueError(f"{path} is an array: use {path}.*")
        return F.transform(column, lambda x: _value(x, kind.elementType, below["*"], path))
    if isinstance(kind, T.StructType):
        names = kind.names if "*" in below else list(below)
        if bad := [n for n in names if n not in kind.names]:
            raise ValueError(f"{path} has no field {bad[0]!r}")
        return F.struct(*[_value(column[n], kind[n].dataType, below.get(n, {}), f"{path}.{n}").alias(n) for n in names])
    raise ValueError(f"{path} has no parts")


def images(posts: DataFrame) -> DataFrame:
    """One row an image, with ``store`` and ``aspect`` (width and height) if the posts have them; a limit on these rows limits images."""
    own = [c for c in ("store", "uri", "author") if c in posts.columns]
    shown = posts.select(*own, F.explode("images").alias("i"))
    has = "aspect" in shown.schema["i"].dataType.names
    return shown.select(*own, "i.fullsize", "i.thumb", "i.alt", *(["i.aspect"] if has else []))
