"""References to hosted repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts, first path parts that are pages and no owners, and second ones after which a ref follows.
HOSTS = ("github.com", "www.github.com", "gist.github.com")
RESERVED = (
    "about", "account", "admin", "apps", "blog", "collections", "contact", "customer-stories", "dashboard", "enterprise", "events", "explore", "features", "home", "issues", "join", "login", "logout", "marketplace", "new", "notifications", "orgs",
    "organizations", "pricing", "pulls", "readme", "search", "security", "sessions", "settings", "signup", "site", "sponsors", "stars", "topics", "trending", "users", "watching",
)
REFS = ("tree", "blob", "commit", "commits", "releases", "tags")
OWNER, NAME = r"^[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}$", r"^[A-Za-z0-9._-]{1,100}$"
SHORT, SCP = r"^([A-Za-z0-9][\w.-]*)/([\w.-]+)$", r"^git@([^:]+):(.+)$"


def repository(text: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    """owner, name, ref and reason (null for a repository) of an address, an ``owner/name`` or an scp-like form."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    short = raw.rlike(SHORT) & ~F.contains(raw, F.lit("://")) & ~raw.rlike(r"(?i)^(?:www\.)?github\.com")
    scp = raw.rlike(SCP)
    url = F.when(raw.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    rest = F.regexp_replace(url, r"^[^:]+://(?:[^/?#]*@)?", "")
    host = F.lower(F.when(scp, F.regexp_extract(raw, SCP, 1)).otherwise(F.regexp_extract(rest, r"^([^/:?#]*)", 1)))
    path = F.when(short, raw).when(scp, F.regexp_extract(raw, SCP, 2)).otherwise(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.url_decode(x))
    owner, name = F.get(parts, 0), F.regexp_replace(F.get(parts, 1), r"(?i)\.git$", "")
    ref = F.when(F.lower(F.get(parts, 2)).isin(*REFS), F.get(parts, 3))
    reason = (
        F.when(raw == "", "empty")
        .when(~short & ~scp & ~host.rlike(r"^[a-z0-9.-]+$"), "malformed")
        .when(~short & ~host.isin(*hosts), "not_github")
        .when(~short & ~scp & (host == "gist.github.com"), "not_a_repository")
        .when(F.size(parts) < 2, "not_a_repository")
        .when(F.lower(owner).isin(*RESERVED), "reserved_path")
        .when(~owner.rlike(OWNER), "invalid_owner")
        .when(~name.rlike(NAME) | name.isin(".", ".."), "invalid_repo")
    )
    ok = reason.isNull()
    return F.struct(F.when(ok, owner).alias("owner"), F.when(ok, name).alias("name"), F.when(ok, ref).alias("ref"), reason.alias("reason"))
