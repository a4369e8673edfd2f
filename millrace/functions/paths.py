"""Path expressions: object-store paths in texts and prefix scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an object-store path, and the wildcard permission.
S3_PATH = r"(?i)s3[an]?://[^\s'\"();,]+"
WILDCARD = "*"
_BRACED_STEPS = r"\{[^}]*(/|\.\.)"


def s3_paths(text: Column) -> Column:
    """Every ``s3://``, ``s3a://`` or ``s3n://`` path in a text, in order, in any letter
    case of the scheme."""
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(S3_PATH), F.lit(0)), F.array().cast("array<string>")
    )


def lower_scheme(path: Column) -> Column:
    """``S3://x``, ``s3a://x`` and ``s3://x`` name the same object, so compare them as one."""
    return F.regexp_replace(path, "^(?i)s3[an]?://", "s3://")


def canonical(path: Column) -> Column:
    """The object a path names: ``s3://``, no empty or ``.`` steps, ``..`` taken back, but
    not beyond the bucket. A slash at the end stays. Other paths are as they are."""
    path = lower_scheme(path)
    bucket = F.regexp_extract(path, "^s3://[^/]*", 0)
    below = F.substr(path, F.length(bucket) + 1)
    steps = F.aggregate(
        F.filter(F.split(below, "/"), lambda s: ~s.isin("", ".")),
        F.array().cast("array<string>"),
        lambda made, s: F.when(s == "..", F.slice(made, F.lit(1), F.greatest(F.size(made) - 1, F.lit(0))))
        .otherwise(F.concat(made, F.array(s))))
    # A path that ends in a dot step names a folder.
    end = F.when(below.rlike(r"(^|/)\.{0,2}$") & (below != ""), F.lit("/")).otherwise("")
    made = F.concat(bucket, F.when(F.size(steps) > 0, F.concat(F.lit("/"), F.array_join(steps, "/"))).otherwise(""), end)
    return F.when(path.rlike(r"^s3://[^/]*.*/(\.{0,2})(/|$)"), made).otherwise(path)


def in_scope(path: Column, allow: Column, deny: Column) -> Column:
    """Deny prefixes win; an empty allow list allows everything else."""

    def any_prefix(prefixes):
        return F.exists(prefixes, lambda p: (p != "") & F.startswith(path, canonical(p)))

    allow, deny = _list(allow), _list(deny)
    return ~any_prefix(deny) & ((F.size(allow) == 0) | any_prefix(allow))


def path_allowed(path: Column, permissions: Column, allow: Column, deny: Column) -> Column:
    """May a role with these lists use the path? Only ``s3://`` paths are scoped, by the
    object they name (:func:`canonical`). A glob whose braces hold steps names several
    objects; it is out of the scope of a role that has one."""
    path = canonical(F.coalesce(path, F.lit("")))
    free = (F.size(_list(allow)) == 0) & (F.size(_list(deny)) == 0)
    return (
        ~F.startswith(path, F.lit("s3://"))
        | F.array_contains(_list(permissions), WILDCARD)
        | free
        | (in_scope(path, allow, deny) & ~path.rlike(_BRACED_STEPS))
    )


def _list(items: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.filter(items, lambda item: item.isNotNull()), empty)
