"""String-shaped scalar functions: purls, slugs, repo URLs, permalinks, PR titles, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranktide.functions.util import as_col

# Fixed values.
NPM_PREFIX = "pkg:npm/"
GITHUB_PREFIX = "pkg:github/"
REPO_URL_PATTERN = r"^https?://github\.com/([^/]+)/([^/?#]+?)(?:\.git)?/?$"
ADVISORY_URL_BASE = "https://github.com/advisories/"
MANIFEST_BLOB_BASE = "https://github.com/e18e/module-replacements/blob/main/manifests/"
# End of fixed values.


def purl_build(ecosystem, name, lower_eco: bool = False) -> Column:
    eco = F.lower(as_col(ecosystem)) if lower_eco else as_col(ecosystem)
    return F.concat(F.lit("pkg:"), eco, F.lit("/"), as_col(name))


def _remove_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def purl_name(purl) -> Column:
    """Short name: strip the npm prefix, then the github prefix."""
    return _remove_prefix(_remove_prefix(as_col(purl), NPM_PREFIX), GITHUB_PREFIX)


def slug(name) -> Column:
    return F.replace(F.replace(as_col(name), F.lit("/"), F.lit("__")), F.lit("@"), F.lit(""))


def canonical_repo(url) -> Column:
    """One spelling for each repository: ``.git`` and a trailing slash don't count; other URLs stay as they are."""
    u = as_col(url)
    owner, repo = repo_owner(u), repo_name(u)
    return F.when(owner.isNotNull() & repo.isNotNull(), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo)).otherwise(u)


def repo_owner(url) -> Column:
    return F.nullif(F.regexp_extract(F.trim(as_col(url)), REPO_URL_PATTERN, 1), F.lit(""))


def repo_name(url) -> Column:
    return F.nullif(F.regexp_extract(F.trim(as_col(url)), REPO_URL_PATTERN, 2), F.lit(""))


def permalink_locations(repo_url, head_sha, locations) -> Column:
    """``ARRAY<STRUCT<file,line>>`` -> ``ARRAY<STRUCT<file,line,url>>`` pinned to a SHA (or HEAD).

    No repo URL (NULL or empty) or no locations -> empty array.
    """
    base = F.regexp_replace(as_col(repo_url), "/+$", "")
    ref = F.coalesce(F.nullif(as_col(head_sha), F.lit("")), F.lit("HEAD"))
    locs = as_col(locations)

    def one(loc: Column) -> Column:
        url = F.concat(base, F.lit("/blob/"), ref, F.lit("/"), loc["file"])
        url = F.when(loc["line"].isNotNull(), F.concat(url, F.lit("#L"), loc["line"].cast("string"))).otherwise(url)
        return F.struct(loc["file"].alias("file"), loc["line"].alias("line"), url.alias("url"))

    empty = F.array().cast("array<struct<file:string,line:int,url:string>>")
    return F.when(
        (F.coalesce(as_col(repo_url), F.lit("")) == "") | locs.isNull() | (F.size(locs) == 0), empty
    ).otherwise(F.transform(locs, one))


def pr_title(kind, project_name, advisory_id, fixed_versions, from_purl, to_purls) -> Column:
    """Suggested PR title for an opportunity (five shapes)."""
    k = as_col(kind)
    fv = as_col(fixed_versions)
    fixed = F.get(fv, 0)
    from_name = _remove_prefix(as_col(from_purl), NPM_PREFIX)
    first_to = F.get(as_col(to_purls), 0)
    target = F.regexp_replace(F.regexp_replace(F.substring_index(first_to, "/", -1), "^<+", ""), ">+$", "")
    scope = F.when(k == "perf-replacement", F.lit("perf")).otherwise(F.lit("deps"))
    return (
        F.when(
            (k == "vulnerability-fix") & as_col(advisory_id).isNotNull(),
            F.when(
                F.size(fv) > 0,
                F.concat(F.lit("fix(deps): bump "), as_col(project_name), F.lit(" to "), fixed, F.lit(" ("), as_col(advisory_id), F.lit(")")),
            ).otherwise(F.concat(F.lit("fix: address "), as_col(advisory_id), F.lit(" in "), as_col(project_name))),
        )
        .when(
            k.isin("dep-replacement", "perf-replacement") & as_col(from_purl).isNotNull(),
            F.when(target == "native", F.concat(scope, F.lit(": drop "), from_name, F.lit(" dep (use native API)")))
            .otherwise(F.concat(scope, F.lit("(deps): replace "), from_name, F.lit(" with "), F.coalesce(target, F.lit("")))),
        )
        .otherwise(F.concat(F.lit("chore("), as_col(project_name), F.lit("): improvement opportunity")))
    )


def parse_ts(value) -> Column:
    """ISO-8601 text -> TIMESTAMP_NTZ keeping the wall clock (zone suffix dropped); '' -> NULL."""
    v = F.nullif(as_col(value), F.lit(""))
    wall = F.regexp_replace(v, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    return wall.try_cast("timestamp_ntz")


def json_evidence(evidence) -> Column:
    """Evidence struct (fields in alphabetical order) -> JSON text, NULL when empty."""
    e = as_col(evidence)
    return F.when(e.isNotNull(), F.to_json(e))
