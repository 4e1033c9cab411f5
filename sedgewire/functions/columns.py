"""Column expressions of the scan model: paths, patterns, hashes, coordinates, text. All run in the JVM."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgewire.schema import MIME_BY_SUFFIX, OTHER_MIME

_BLANKS = r"^[\s\x{1c}-\x{1f}\x{85}]+|[\s\x{1c}-\x{1f}\x{85}]+$"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end (Spark's trim takes blanks only)."""
    return F.regexp_replace(c, _BLANKS, "")


def suffix(path: Column) -> Column:
    """The lower-case suffix with its dot: the last dot of the name, unless it begins or ends it; else empty."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def guess_mime(path: Column) -> Column:
    """The media type by suffix."""
    table = F.create_map(*[F.lit(x) for pair in MIME_BY_SUFFIX.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit(OTHER_MIME))


def extractor(mime: Column, path: Column) -> Column:
    """Which extractor reads a file: image, pdf, docx, video or none; the first that applies."""
    s = suffix(path)
    return (
        F.when(mime.startswith("image/") | s.isin(".jpg", ".jpeg", ".png"), "image")
        .when((mime == "application/pdf") | (s == ".pdf"), "pdf")
        .when(s == ".docx", "docx")
        .when(mime.startswith("video/") | s.isin(".mp4", ".mov", ".m4v"), "video")
        .otherwise("none")
    )


def relative_path(path: Column, base: str | None) -> Column:
    """Relative to base; as it is if base is None or doesn't hold it."""
    if base is None:
        return path
    root = base.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def normalized_extension(ext: Column) -> Column:
    """Trimmed, lower case, with a leading dot; blank stays empty."""
    x = F.lower(stripped(ext))
    return F.when((x == "") | x.startswith("."), x).otherwise(F.concat(F.lit("."), x))


def include_extensions(raw: Column) -> Column:
    """The distinct extensions of a comma list; null if it names none (no filter)."""
    parts = F.array_distinct(F.filter(F.transform(F.split(raw, ","), normalized_extension), lambda x: x != ""))
    return F.when(F.size(parts) > 0, parts)


def split_patterns(patterns: Column) -> Column:
    """All comma parts of an array of strings, trimmed, without blanks, in order."""
    return F.filter(F.flatten(F.transform(patterns, lambda p: F.transform(F.split(p, ","), stripped))), lambda x: x != "")


def is_glob(pattern: Column) -> Column:
    return pattern.rlike(r"[*?\[]")


def normalized_pattern(pattern: Column) -> Column:
    """Trimmed, with slashes, lower case, without one leading ./"""
    return F.regexp_replace(F.lower(F.replace(stripped(pattern), F.lit("\\"), F.lit("/"))), r"^\./", "")


def excluded(path: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern matches the lower-case path: globs as a whole (* crosses slashes; */x also stands for x), others as a part."""
    low, tests = F.lower(path), []
    for raw in patterns:
        p = raw.strip().replace("\\", "/").lower().removeprefix("./")
        if not p:
            continue
        if any(c in p for c in "*?["):
            forms = [p, p[2:]] if p.startswith("*/") else [p]
            # (?s:...)\z in Python's spelling; Java writes the end as \z
            tests += [low.rlike("^" + fnmatch.translate(f).replace(r"\Z", r"\z")) for f in forms]
        else:
            tests.append(low.contains(p))
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def content_hash(content: Column, algorithm: str | None) -> Column:
    """Lower-case hex of sha256 or md5; null for none or blank. Another algorithm is an error."""
    name = (algorithm or "").strip().lower()
    if name in ("", "none"):
        return F.lit(None).cast("string")
    if name == "sha256":
        return F.sha2(content, 256)
    if name == "md5":
        return F.md5(content)
    raise ValueError(f"unsupported hash algorithm: {algorithm}")


def cache_key(mode: str, sha256: Column, mtime: Column, size: Column) -> Column:
    """sha256:<hex>, or mtime:<whole seconds>:<size>. Another mode is an error."""
    if mode == "sha256":
        return F.concat(F.lit("sha256:"), sha256)
    if mode == "mtime":
        return F.concat(F.lit("mtime:"), mtime.cast("long").cast("string"), F.lit(":"), size.cast("string"))
    raise ValueError(f"unsupported cache mode: {mode}")


def rational(numerator: Column, denominator: Column) -> Column:
    """n / d as double, 0 where it isn't defined."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column) -> Column:
    return degrees + minutes / F.lit(60.0) + seconds / F.lit(3600.0)


def signed_degrees(value: Column, ref: Column) -> Column:
    """South and west are negative."""
    return F.when(F.upper(ref).rlike("^[SW]"), -value).otherwise(value)


def html_escaped(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys at every depth."""
    return F.to_json(F.parse_json(text))


def with_error(errors: Column, code: Column, stage: Column, message: Column) -> Column:
    """An array of structured errors with one more; a null array is empty, an empty code or stage is "unknown"."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    one = F.struct(known(code).alias("error_code"), known(stage).alias("stage"), F.coalesce(message, F.lit("")).alias("message_short"))
    return F.concat(F.coalesce(errors, F.array().cast("array<struct<error_code:string,stage:string,message_short:string>>")), F.array(one))


def without_keys(metadata: Column, keys: Sequence[str]) -> Column:
    """A string map without these keys."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(*keys))
