"""Digests that identify scopes, items and artifacts. Fields are in the order of their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


#: Versions that identities name (fixed values).
MANIFEST, SCOPE, POLICY = "acquisition-manifest.v1", "monitor-scope-semantic.v2", "access-policy.v1"


def canonical_json(*fields: tuple[str, Column], ascii_only: bool = False) -> Column:
    """The compact JSON object of the fields, sorted by name, escapes in lower case; nulls are kept."""
    options = KEEP_NULLS | {"writeNonAsciiCharacterAsCodePoint": str(ascii_only).lower()}
    wire = F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])]), options)
    tokens = F.regexp_extract_all(wire, F.lit(r"(?s)\\u[0-9A-F]{4}|\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda x: F.when(F.startswith(x, F.lit("\\u")), F.lower(x)).otherwise(x)), "")


def digest(*fields: tuple[str, Column], ascii_only: bool = False) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(*fields, ascii_only=ascii_only), 256)


def _seed(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", "")


def _prefixes(values: Column) -> Column:
    """Sorted distinct prefixes with a slash before and none behind; blank ones go."""
    bare = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    rooted = F.transform(bare, lambda x: F.regexp_replace(F.when(F.startswith(x, F.lit("/")), x).otherwise(F.concat(F.lit("/"), x)), "(?<=.)/+$", ""))
    return F.array_sort(F.array_distinct(rooted))


def scope_fingerprint(seed: Column, page_prefixes: Column, file_prefixes: Column, fetch_mode: Column) -> Column:
    mode = F.lower(F.trim(F.coalesce(fetch_mode, F.lit(""))))
    return digest(
        ("seed_url", _seed(seed)),
        ("allowed_page_prefixes", _prefixes(page_prefixes)),
        ("allowed_file_prefixes", _prefixes(file_prefixes)),
        ("fetch_mode", F.when(mode == "", "http").otherwise(mode)),
        ascii_only=True,
    )


def semantic_fingerprint(site_key: Column, seed: Column, homepage: Column, page_prefixes: Column, file_prefixes: Column, tree_strategy: Column, file_scope_mode: Column, max_depth: Column, max_pages: Column, max_files: Column) -> Column:
    """Identity of a plan as it will be run, limits included; prefixes are taken as they are."""
    return digest(
        ("algorithm", F.lit(SCOPE)),
        ("site_key", site_key),
        ("seed_url", _seed(seed)),
        ("homepage_url", _seed(homepage)),
        ("allowed_page_prefixes", F.array_sort(F.array_distinct(page_prefixes))),
        ("allowed_file_prefixes", F.array_sort(F.array_distinct(file_prefixes))),
        ("tree_strategy", tree_strategy),
        ("file_scope_mode", file_scope_mode),
        ("max_depth", max_depth),
        ("max_pages", max_pages),
        ("max_files", max_files),
        ascii_only=True,
    )


def policy_key(origin: Column, identity_sha256: Column) -> Column:
    """Key of a cached access policy."""
    return digest(("canonical_origin", origin), ("identity_sha256", identity_sha256), ("policy_version", F.lit(POLICY)))


def prefixed(prefix: str, length: int, hashed: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(hashed, 1, length))


def item_id(scope: Column, url: Column) -> Column:
    return prefixed("item", 16, F.sha2(F.concat_ws(":", scope.cast("string"), url), 256))


def artifact_id(run: Column, source: Column, sha256: Column, manifest: str = MANIFEST) -> Column:
    """Of a run, a normalised source and the content's digest, which may be null."""
    return prefixed("artifact", 24, digest(("manifest_version", F.lit(manifest)), ("normalized_source_identity", source), ("sha256", sha256), ("source_run_id", run)))


def version_id(run: Column, source: Column, sha256: Column, manifest: str = MANIFEST) -> Column:
    """The artifact's digest under another prefix."""
    return F.replace(artifact_id(run, source, sha256, manifest), F.lit("artifact-"), F.lit("version-"))


def lineage_id(artifact: Column, relation: Column, related: Column, ordinal: Column) -> Column:
    return prefixed("lineage", 24, digest(("artifact_id", artifact), ("ordinal", ordinal), ("related_artifact_id", related), ("relation", relation)))


def asset_id(sha256: Column, document_id: Column) -> Column:
    return F.when(F.coalesce(sha256, F.lit("")) != "", prefixed("sha256", 16, sha256)).otherwise(F.concat(F.lit("document-"), document_id.cast("string")))
