"""Who may read what: visibility rules, grants, the tree of collections, and the set of readable documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import tree as trees


def active(as_of: Column, expires: str = "expires_at") -> Column:
    """FIL-02: not expired at as_of."""
    return F.col(expires).isNull() | (F.col(expires) > as_of)


def contains(keyword: str | None, *columns: str) -> Column:
    """FIL-04/05: any column contains the keyword in any case; its wildcards hold. Without a keyword: all rows."""
    if not keyword:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).like(f"%{keyword.lower()}%"), F.lit(False)) for c in columns])


def optional(column: str, value) -> Column:
    """FIL-03: column = value, or all rows where value is None."""
    return F.lit(True) if value is None else F.col(column) == value


def closure(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """SET-10: the closure of a tree (id, parent_id); see lectern.operators.tree."""
    return trees.closure(nodes)


def ancestors(tree: DataFrame, node: int) -> DataFrame:
    """SET-07: node and all above it."""
    return tree.filter(F.col("descendant_id") == node).select(F.col("ancestor_id").alias("id"), "depth")


def descendants(tree: DataFrame, node: int) -> DataFrame:
    """SET-08: node and all below it."""
    return tree.filter(F.col("ancestor_id") == node).select(F.col("descendant_id").alias("id"), "depth")


def effective_collections(tree: DataFrame, members: DataFrame, document: int) -> DataFrame:
    """SET-09: the collections that hold a document, directly or through a descendant."""
    return tree.join(members.filter(F.col("document_id") == document), F.col("descendant_id") == F.col("collection_id")).select(F.col("ancestor_id").alias("id")).distinct()


def granted(grants: DataFrame, target: str, user: DataFrame, roles: DataFrame, as_of: Column, right: str = "can_read") -> DataFrame:
    """AGG-02, PERM-07: unexpired grants with the right that reach the user by name, department or role. user has one row."""
    live = grants.filter((F.col("target_type") == target) & F.col(right) & active(as_of))
    if target == "USER":
        return live.join(user.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    if target == "DEPARTMENT":
        return live.join(user.select("department_id"), "department_id", "left_semi")
    return live.join(roles.join(user, roles["user_id"] == user["id"], "left_semi").select("role_id"), "role_id", "left_semi")


def readable_documents(t, user_id: int, as_of: Column, tree: DataFrame, statuses: tuple[str, ...] = ("INDEXED",)) -> DataFrame:
    """SET-01: ids the user may read: the distinct union of eight ways, each of them a join on keys.

    t: tables users, user_roles, files, access_cache, document_grants, collection_grants, collection_documents.
    """
    user = t.users.filter(F.col("id") == user_id)
    files = t.files.filter(F.col("status").isin(*statuses)).select("id", "owner_user_id", "visibility")
    owners = t.users.select(F.col("id").alias("owner_user_id"), F.col("department_id").alias("owner_department"))
    same = files.filter(F.col("visibility") == "DEPARTMENT").join(owners, "owner_user_id").join(user.select(F.col("department_id").alias("owner_department")), "owner_department", "left_semi")
    cached = t.access_cache.filter((F.col("user_id") == user_id) & F.col("can_read") & ~F.col("invalidated") & active(as_of))
    direct = [granted(t.document_grants, k, user, t.user_roles, as_of).select(F.col("document_id").alias("id")) for k in ("ROLE", "DEPARTMENT")]
    inherited = [
        granted(t.collection_grants, k, user, t.user_roles, as_of).select("collection_id").join(tree, F.col("collection_id") == F.col("ancestor_id")).select(F.col("descendant_id").alias("collection_id")).join(t.collection_documents, "collection_id").select(F.col("document_id").alias("id"))
        for k in ("ROLE", "DEPARTMENT")
    ]
    listed = reduce(DataFrame.union, [cached.select(F.col("document_id").alias("id")), *direct, *inherited])
    branches = [files.filter(F.col("owner_user_id") == user_id), files.filter(F.col("visibility") == "PUBLIC"), same, files.join(listed, "id", "left_semi")]
    return reduce(DataFrame.union, [b.select("id") for b in branches]).distinct()


def readable_collections(t, user_id: int, as_of: Column, tree: DataFrame, keyword: str | None = None) -> DataFrame:
    """SET-03: id, name, parent, day of active collections the user owns, that are public, or granted to them (role and department grants reach descendants)."""
    user = t.users.filter(F.col("id") == user_id)
    nodes = t.collections
    inherited = [
        granted(t.collection_grants, k, user, t.user_roles, as_of).select(F.col("collection_id").alias("ancestor_id")).join(tree, "ancestor_id").select(F.col("descendant_id").alias("id"))
        for k in ("ROLE", "DEPARTMENT")
    ]
    named = granted(t.collection_grants, "USER", user, t.user_roles, as_of).select(F.col("collection_id").alias("id"))
    branches = [nodes.filter(F.col("owner_user_id") == user_id), nodes.filter(F.col("visibility") == "PUBLIC"), named, *inherited]
    ids = reduce(DataFrame.union, [b.select("id") for b in branches]).distinct()
    return nodes.join(ids, "id", "left_semi").filter((F.col("status") == "ACTIVE") & contains(keyword, "name", "description")).select("id", "name", "parent_id", "created_day")


def page(rows: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    """TOP-04, WIN-01: one page of rows with the total beside it. The total is one broadcast row, not a window over all rows."""
    total = rows.agg(F.count("*").alias("total_count"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


FLAGS = ("can_read", "can_write", "can_admin")


def _flagged(rows: DataFrame, key: str, rule: str, *flags: bool) -> DataFrame:
    """id, rule and the three flags: those given, or else the columns of rows."""
    values = [F.lit(f).alias(c) for c, f in zip(FLAGS, flags, strict=True)] if flags else [F.col(c) for c in FLAGS]
    return rows.select(F.col(key).alias("id"), F.lit(rule).alias("rule"), *values)


def _reaching(grants: DataFrame, kind: str, user: DataFrame, t, as_of: Column) -> DataFrame:
    """Unexpired grants of the kind that reach the user, whatever their flags."""
    return granted(grants.withColumn("any", F.lit(True)), kind, user, t.user_roles, as_of, "any")


def _inherited(t, kind: str, user: DataFrame, as_of: Column, tree: DataFrame) -> DataFrame:
    """collection_id and flags of role or department grants, carried down the tree."""
    reach = _reaching(t.collection_grants, kind, user, t, as_of).select(F.col("collection_id").alias("ancestor_id"), *FLAGS)
    return reach.join(tree, "ancestor_id").select(F.col("descendant_id").alias("collection_id"), *FLAGS)


def _summed(parts: list[DataFrame], key: str) -> DataFrame:
    every = reduce(DataFrame.unionByName, parts).filter("can_read OR can_write OR can_admin")
    return every.groupBy(F.col("id").alias(key)).agg(*[F.max(f).alias(f) for f in FLAGS], F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


def backed_cache(t, user_id: int, as_of: Column) -> DataFrame:
    """document_id and flags of the user's valid cache rows: only the rights that what they were made from still gives."""
    valid = t.access_cache.filter((F.col("user_id") == user_id) & ~F.col("invalidated") & active(as_of)).select("document_id", "source_type", *FLAGS)
    mine = lambda grants: grants.filter((F.col("target_type") == "USER") & (F.col("user_id") == user_id) & active(as_of))
    own = t.files.filter(F.col("owner_user_id") == user_id).select(F.col("id").alias("document_id"), *[F.lit(True).alias(f"backed_{c}") for c in FLAGS])
    backed = [F.col(c).alias(f"backed_{c}") for c in FLAGS]
    shelf = mine(t.collection_grants).join(t.collection_documents, "collection_id").select("document_id", *backed)
    backing = {"OWNER": own, "DIRECT_DOCUMENT_PERMISSION": mine(t.document_grants).select("document_id", *backed), "DIRECT_COLLECTION_PERMISSION": shelf}
    both = [(F.col(c) & F.col(f"backed_{c}")).alias(c) for c in FLAGS]
    return reduce(DataFrame.union, [valid.filter(F.col("source_type") == k).join(b, "document_id").select("document_id", *both) for k, b in backing.items()])


def permission_summary(t, user_id: int, as_of: Column, tree: DataFrame | None) -> DataFrame:
    """PERM-01..03: document_id, can_read, can_write, can_admin, rules for every document that any rule reaches.

    Without a tree only owners, visibility and grants on the documents themselves count; with one also the checked cache
    and the role and department grants on collections, direct and inherited.
    """
    user = t.users.filter(F.col("id") == user_id)
    owner = _flagged(t.files.filter(F.col("owner_user_id") == user_id), "id", "OWNER", True, True, True)
    public = _flagged(t.files.filter(F.col("visibility") == "PUBLIC"), "id", "PUBLIC", True, False, False)
    owners = t.users.select(F.col("id").alias("owner_user_id"), F.col("department_id").alias("owner_department"))
    same = t.files.filter(F.col("visibility") == "DEPARTMENT").join(owners, "owner_user_id").join(user.select(F.col("department_id").alias("owner_department")), "owner_department", "left_semi")
    parts = [owner, public, _flagged(same, "id", "DEPARTMENT", True, False, False)]
    parts += [_flagged(_reaching(t.document_grants, kind, user, t, as_of), "document_id", f"{kind}_GRANT") for kind in ("USER", "ROLE", "DEPARTMENT")]
    if tree is not None:
        parts.append(_flagged(backed_cache(t, user_id, as_of), "document_id", "USER_CACHE"))
        parts += [_flagged(_inherited(t, kind, user, as_of, tree).join(t.collection_documents, "collection_id"), "document_id", f"{kind}_COLLECTION_GRANT") for kind in ("ROLE", "DEPARTMENT")]
    return _summed(parts, "document_id")


def collection_summary(t, user_id: int, as_of: Column, tree: DataFrame) -> DataFrame:
    """PERM-04: collection_id, can_read, can_write, can_admin, rules. Role and department grants reach descendants, grants to the user don't."""
    user = t.users.filter(F.col("id") == user_id)
    parts = [_flagged(t.collections.filter(F.col("owner_user_id") == user_id), "id", "OWNER", True, True, True), _flagged(t.collections.filter(F.col("visibility") == "PUBLIC"), "id", "PUBLIC", True, False, False)]
    parts.append(_flagged(_reaching(t.collection_grants, "USER", user, t, as_of), "collection_id", "USER_GRANT"))
    parts += [_flagged(_inherited(t, kind, user, as_of, tree), "collection_id", f"{kind}_GRANT") for kind in ("ROLE", "DEPARTMENT")]
    return _summed(parts, "collection_id")


def _ordered(parts: list[tuple[str, DataFrame]], key: str, owned: DataFrame) -> DataFrame:
    """key, the three flags and sources, in the order of the parts (id and flags); an owner has all rights and no other source."""
    rank = {name: k for k, (name, _) in enumerate(parts, 1)}
    each = [p.filter("can_read OR can_write OR can_admin").select("id", *FLAGS, F.lit(rank[name]).alias("rank")) for name, p in parts]
    own = owned.select("id", *[F.lit(True).alias(f) for f in FLAGS], F.lit(0).alias("rank"))
    reached = reduce(DataFrame.union, each).join(owned.select("id"), "id", "left_anti").union(own)
    names = F.array(F.lit("OWNER"), *[F.lit(name) for name, _ in parts])
    sources = F.array_join(F.transform(F.array_sort(F.collect_set("rank")), lambda r: F.get(names, r)), ",")
    return reached.groupBy(F.col("id").alias(key)).agg(*[F.max(f).alias(f) for f in FLAGS], sources.alias("sources"))


def _on_documents(t, kind: str, user: DataFrame, as_of: Column, tree: DataFrame) -> DataFrame:
    """id and flags of documents that the user's grants of the kind reach: on the document, on a collection that holds it, or on one above."""
    direct = _reaching(t.document_grants, kind, user, t, as_of).select(F.col("document_id").alias("id"), *FLAGS)
    return direct.union(_inherited(t, kind, user, as_of, tree).join(t.collection_documents, "collection_id").select(F.col("document_id").alias("id"), *FLAGS))


def checked_documents(t, user_id: int, as_of: Column, tree: DataFrame) -> DataFrame:
    """PERM-01..03: document_id, the three rights and their sources, rule after rule.

    An owner has all rights and is asked nothing more. Else come public and department visibility (reading alone), rights of
    the user by the checked cache only, and role and department grants, direct or inherited.
    """
    user = t.users.filter(F.col("id") == user_id)
    others = t.files.select("id", "owner_user_id", "visibility")
    owners = t.users.select(F.col("id").alias("owner_user_id"), F.col("department_id").alias("owner_department"))
    seen = others.filter(F.col("visibility") == "DEPARTMENT").join(owners, "owner_user_id").join(user.select(F.col("department_id").alias("owner_department")), "owner_department", "left_semi")
    reading = lambda d: d.select("id", F.lit(True).alias("can_read"), F.lit(False).alias("can_write"), F.lit(False).alias("can_admin"))
    parts = [("PUBLIC", reading(others.filter(F.col("visibility") == "PUBLIC"))), ("DEPARTMENT_VISIBILITY", reading(seen)), ("USER_CACHE", backed_cache(t, user_id, as_of).withColumnRenamed("document_id", "id"))]
    parts += [(kind, _on_documents(t, kind, user, as_of, tree)) for kind in ("ROLE", "DEPARTMENT")]
    return _ordered(parts, "document_id", others.filter(F.col("owner_user_id") == user_id)).join(others.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def checked_collections(t, user_id: int, as_of: Column, tree: DataFrame) -> DataFrame:
    """PERM-04: collection_id, the three rights and their sources; deleted collections give none. Grants to the user hold for the collection itself, those to roles and departments below it as well."""
    user = t.users.filter(F.col("id") == user_id)
    live = t.collections.filter(F.col("status") != "DELETED")
    public = live.filter(F.col("visibility") == "PUBLIC").select("id", F.lit(True).alias("can_read"), F.lit(False).alias("can_write"), F.lit(False).alias("can_admin"))
    parts = [("PUBLIC", public), ("USER", _reaching(t.collection_grants, "USER", user, t, as_of).select(F.col("collection_id").alias("id"), *FLAGS))]
    parts += [(kind, _inherited(t, kind, user, as_of, tree).select(F.col("collection_id").alias("id"), *FLAGS)) for kind in ("ROLE", "DEPARTMENT")]
    return _ordered(parts, "collection_id", live.filter(F.col("owner_user_id") == user_id)).join(live.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")


def authoritative_cache(t, as_of: Column) -> DataFrame:
    """PERM-05: cache rows that are valid and still backed by what they were made from."""
    valid = t.access_cache.filter(~F.col("invalidated") & F.col("can_read") & active(as_of)).select("user_id", "document_id", "source_type")
    own = t.files.select(F.col("id").alias("document_id"), F.col("owner_user_id").alias("user_id"))
    named = t.document_grants.filter((F.col("target_type") == "USER") & F.col("can_read") & active(as_of)).select("document_id", "user_id")
    shelf = t.collection_grants.filter((F.col("target_type") == "USER") & F.col("can_read") & active(as_of)).join(t.collection_documents, "collection_id").select("document_id", F.col("user_id").cast("long").alias("user_id"))
    backing = {"OWNER": own, "DIRECT_DOCUMENT_PERMISSION": named, "DIRECT_COLLECTION_PERMISSION": shelf}
    return reduce(DataFrame.union, [valid.filter(F.col("source_type") == k).join(b, ["user_id", "document_id"], "left_semi") for k, b in backing.items()])
