"""URL functions by generic-syntax splitting, so malformed links stay usable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from pagemill import fixed_values as fixed
from pagemill.functions.common import let, strip

# scheme, netloc, path, query, fragment (RFC 3986, appendix B)
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
HIERARCHICAL = ["http", "https", "ftp", "sftp", "file", "ws", "wss"]


def split_url(url: Column) -> Column:
    """struct(scheme, netloc, path, params, query, fragment) of a URL; absent parts are ''."""

    def plain(text: Column) -> Column:
        cleaned = F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
        return F.when(text.rlike(r"[\x00-\x20]"), cleaned).otherwise(text)

    def parts(found: Column) -> Column:
        part = lambda at: F.get(found, F.lit(at))
        with_params = F.contains(part(2), F.lit(";"))
        return F.struct(
            F.lower(part(0)).alias("scheme"),
            part(1).alias("netloc"),
            F.when(with_params, F.regexp_replace(part(2), r";[^/]*$", "")).otherwise(part(2)).alias("path"),
            F.when(with_params, F.regexp_extract(part(2), r"(;[^/]*)$", 1)).otherwise(F.when(part(2).isNotNull(), "")).alias("params"),
            part(3).alias("query"),
            part(4).alias("fragment"),
        )

    # One match gives all parts: a cleaned URL holds no line feed, so they can stand in lines.
    return let(F.split(F.regexp_replace(let(url, plain), PARTS, "$1\n$2\n$3\n$4\n$5"), "\n", -1), parts)


def _join(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column | None = None):
    def joined(p: Column) -> Column:
        rooted = F.when((p["netloc"] != "") & (p["path"] != "") & ~F.startswith(p["path"], F.lit("/")), F.concat(F.lit("/"), p["path"]))
        return F.concat(
            F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""),
            F.when(p["netloc"] != "", F.concat(F.lit("//"), p["netloc"])).otherwise(""),
            rooted.otherwise(p["path"]),
            params,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        )

    url = let(F.struct(scheme.alias("scheme"), netloc.alias("netloc"), path.alias("path")), joined)
    if fragment is None:
        return url
    return F.concat(url, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def _without_www(netloc: Column) -> Column:
    return F.regexp_replace(netloc, r"^www\.(?=.)", "")


def normalize_url(url: Column) -> Column:
    """No fragment, no leading ``www.``, lower-case host, no trailing ``/``; default https."""

    def build(p: Column, path: Column) -> Column:
        # A bare "Host/x" gets its host back, and is treated like one with a scheme.
        bare = (p["scheme"] == "") & (p["netloc"] == "") & ~F.startswith(p["path"], F.lit("/")) & (path != "")
        host = F.when(bare, F.substring_index(path, "/", 1)).otherwise(p["netloc"])
        rest = F.when(bare, F.substr(path, F.length(F.substring_index(path, "/", 1)) + 1)).otherwise(path)
        with_root = let(rest, lambda text: F.when(text == "", F.lit("/")).otherwise(text))
        return _join(
            F.when(p["scheme"] == "", F.lit("https")).otherwise(p["scheme"]),
            _without_www(F.lower(host)), with_root, p["params"], p["query"],
        )

    return let(split_url(strip(url)), lambda p: let(F.regexp_replace(p["path"], r"/+$", ""), lambda path: build(p, path)))


def with_parts(base: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of a base URL and its parts, both computed once per row however many references meet them."""
    return let(let(base, lambda b: F.struct(b.alias("url"), split_url(b).alias("parts"))), lambda b: body(b["url"], b["parts"]))


def is_valid_url(url: Column, base_domain: Column | str | None = None) -> Column:
    """http(s) with a host, and on ``base_domain`` when one is given."""

    def check(p: Column) -> Column:
        good = p["scheme"].isin("http", "https") & (p["netloc"] != "")
        if base_domain is None:
            return good
        wanted = F.lit(base_domain) if isinstance(base_domain, str) else base_domain
        host = F.regexp_replace(F.lower(p["netloc"]), r"^www\.", "")
        return good & ((wanted == "") | (host == wanted))

    return F.coalesce(let(split_url(url), check), F.lit(False))


def excluded_pattern() -> str:
    suffixes = "|".join(suffix.replace(".", r"\.") for suffix in fixed.EXCLUDED_SUFFIXES)
    return rf"(?i)\.({suffixes})$|" + "|".join(fixed.EXCLUDED_SCHEMES)


def should_exclude_url(url: Column, pattern: str | None = None) -> Column:
    """Media and document suffixes, and schemes that are no pages."""
    return url.rlike(pattern or excluded_pattern())


def domain(url: Column) -> Column:
    return split_url(url)["netloc"]


def path(url: Column) -> Column:
    return split_url(url)["path"]


def default_scheme(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` among the segments of a path."""

    def fold(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda done, seg: F.when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(seg == ".", done)
            .otherwise(F.concat(done, F.array(seg))),
        )
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(kept, tail), "/")

    def folded(text: Column) -> Column:
        # Without a dot at the start of a segment there is nothing to resolve.
        return F.when(F.contains(text, F.lit("/.")) | F.startswith(text, F.lit(".")), let(F.split(text, "/"), fold)).otherwise(text)

    return let(let(path, folded), lambda joined: F.when(joined == "", F.lit("/")).otherwise(joined))


def resolve_url(base: Column, href: Column, parts: Column | None = None) -> Column:
    """Absolute form of ``href`` as found on page ``base``; ``parts`` is the split base, where many references meet one base."""

    def resolve(pair: Column) -> Column:
        b, h = pair["b"], pair["h"]
        scheme = F.when(h["scheme"] == "", b["scheme"]).otherwise(h["scheme"])
        rooted = F.startswith(h["path"], F.lit("/"))
        base_dir = F.regexp_replace(b["path"], r"[^/]+$", "")
        # Empty inner segments vanish in the merged path, never the first or last.
        merged = F.regexp_replace(F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir), h["path"]), "/{2,}", "/")
        full = F.when(rooted, h["path"]).otherwise(merged)
        path_ = _fold_dots(full)
        foreign = (scheme != b["scheme"]) | (~scheme.isin(*HIERARCHICAL) & (scheme != ""))
        same_page = (h["path"] == "") & (h["params"] == "")
        query = F.when(same_page & (h["query"] == ""), b["query"]).otherwise(h["query"])
        return (
            F.when(foreign, href)
            .when(h["netloc"] != "", _join(scheme, h["netloc"], h["path"], h["params"], h["query"], h["fragment"]))
            .when(same_page, _join(scheme, b["netloc"], b["path"], b["params"], query, h["fragment"]))
            .otherwise(_join(scheme, b["netloc"], path_, h["params"], h["query"], h["fragment"]))
        )

    pair = F.struct((split_url(base) if parts is None else parts).alias("b"), split_url(href).alias("h"))
    return F.when(href == "", base).when(base == "", href).otherwise(let(pair, resolve))


def link_type(url: Column, base: Column, parts: Column | None = None) -> Column:
    """``internal`` on the page's own host, ``relative`` without a host, else ``external``; ``parts`` is the split base, where it is at hand."""
    return let(
        F.struct(domain(url).alias("u"), (domain(base) if parts is None else parts["netloc"]).alias("b")),
        lambda d: F.when(d["u"] == d["b"], "internal").when(d["u"] == "", "relative").otherwise("external"),
    )
