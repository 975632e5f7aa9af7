"""Sources, signatures, addresses and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes in hex, and the media type they show.
SIGNATURES = [("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("52494646", "image/webp"), ("424D", "image/bmp")]
DECLARED = ["image/png", "image/jpeg", "image/jpg", "image/gif", "image/webp", "image/bmp"]


def scheme(source: Column) -> Column:
    """The first resolver that takes a source, in order; 'unknown' if none does."""
    cleaned = F.regexp_replace(source, r"\s+", "")
    return (
        F.when(source.rlike("(?i)^data:"), "data")
        .when(source.startswith("file://"), "file")
        .when(source.startswith("~"), "home")
        .when(source.rlike("(?i)^https?://"), "http")
        .when(source.startswith("upload://"), "upload")
        .when(source.startswith("download://"), "download")
        .when(source.rlike(r"^[./]|\.(png|jpe?g|gif|webp|bmp)$"), "path")
        .when((F.length(cleaned) > 50) & cleaned.rlike("^[A-Za-z0-9+/_-]+=*$"), "base64")
        .otherwise("unknown")
    )


def clean_base64(text: Column) -> Column:
    """Trimmed, percent-decoded where that works, spaces back to plus signs, other white space dropped."""
    t = F.trim(text)
    decoded = F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
    return F.regexp_replace(F.replace(F.when(F.contains(t, F.lit("%")), decoded).otherwise(t), F.lit(" "), F.lit("+")), r"\s+", "")


def sniff(content: Column, declared: Column) -> Column:
    """Media type by leading bytes, else the declared one if it is an image type, else null."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(F.lower(declared).isin(DECLARED), F.lower(declared))
    for magic, kind in reversed(SIGNATURES):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def supported(content: Column) -> Column:
    return sniff(content, F.lit(None).cast("string")).isNotNull()


def blocked_ip(ip: Column) -> Column:
    """Whether an address must not be fetched; what is no address is blocked. IPv4-mapped addresses are judged by their IPv4."""
    low = F.lower(ip)
    inner = F.regexp_replace(low, "^::ffff:", "")
    octets = [F.split(inner, r"\.")[k].try_cast("int") for k in range(4)]
    is4 = F.coalesce(inner.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), F.lit(False))
    a, b = octets[0], octets[1]
    valid = F.when(is4, F.greatest(*octets) <= 255).otherwise(False)
    private = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    six = F.coalesce(low.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & ~low.rlike(":::"), F.lit(False))
    local6 = (low == "::1") | low.rlike("^(fe[89ab]|f[cd])")
    return F.when(is4, F.when(valid, private).otherwise(True)).when(F.coalesce(low.startswith("::ffff:"), F.lit(False)), True).when(six, local6).otherwise(True)


def public_url(url: Column) -> Column:
    """Why a URL is refused before any look-up of names, or null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(~F.coalesce(url.rlike("(?i)^https?://"), F.lit(False)), "scheme").when(host.isNull() | (host == ""), "host").when((host == "localhost") | host.endswith(".localhost"), "localhost").when(host.rlike(r"^[0-9.]+$|:") & blocked_ip(host), "address")


def normal_path(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def within(base: Column, path: Column) -> Column:
    """Whether a path, relative to ``base`` unless absolute, stays in ``base``."""
    b, p = normal_path(base), normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))
    return (p == b) | p.startswith(F.when(b == "/", "/").otherwise(F.concat(b, F.lit("/"))))


def download_error(status: Column, content_type: Column, declared_bytes: Column, content: Column, most: int = 20 * 1024 * 1024) -> Column:
    """Why a fetched reply is refused, the first reason in order, or null."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(~status.between(200, 299), "http")
        .when(F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/json")), "content_type")
        .when(declared_bytes > most, "declared_size")
        .when(F.length(content) == 0, "empty")
        .when(F.length(content) > most, "size")
        .when(~supported(content), "signature")
    )
