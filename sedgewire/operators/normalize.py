"""Raw records of any shape as nine sections, by what each value is.

A raw record is a variant: a field counts only if its value has the kind that belongs there, whatever the other records hold. A number
where a text should be, a text where a part should be, or a truth value where a number should be leave the field null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.functions.columns import stripped


def _at(v: Column, *names: str) -> Column:
    """The value below these names, null if there is none."""
    return F.try_variant_get(v, "$" + "".join(f".{n}" for n in names), "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _part(v: Column, name: str) -> Column:
    """A part of the record if it is an object."""
    part = _at(v, name)
    return F.when(_kind(part).startswith("OBJECT"), part)


def _text(v: Column) -> Column:
    """A value that is a text and not empty."""
    return F.when(_kind(v) == "STRING", F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")))


def _trimmed(v: Column) -> Column:
    return F.nullif(stripped(_text(v)), F.lit(""))


def _number(v: Column) -> Column:
    return F.when(_kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def _positive(v: Column) -> Column:
    """A whole number above 0."""
    n = F.when(_kind(v).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))"), F.try_variant_get(v, "$", "long"))
    return F.when(n > 0, n)


def normalized(v: Column) -> dict[str, Column]:
    """The sections of a raw record (a variant) but for raw itself.

    Of two sources of a field the later one wins (author: docx over pdf; software: docx over pdf over exif), but for created and modified the earlier.
    The times of a part count only beside that part.
    """
    exif, pdf, docx, gps, video = (_part(v, name) for name in ("exif", "pdf", "docx", "gps_norm", "video"))
    times = lambda part, name: F.when(part.isNotNull(), _part(v, name))
    exif_times, pdf_times, docx_times, os_times = times(exif, "exif_times"), times(pdf, "pdf_times"), times(docx, "docx_times"), _part(v, "os_times")
    makers = F.array_distinct(F.array_compact(F.array(_trimmed(_at(pdf, "Creator")), _trimmed(_at(pdf, "Producer")))))
    software = F.coalesce(F.nullif(F.array_join(makers, "; "), F.lit("")), _trimmed(_at(exif, "Software")))
    software = F.when(docx.isNotNull() & ~F.lower(F.coalesce(software, F.lit(""))).contains("docx"), "docx").otherwise(software)
    lat, lon, alt, dop = (_number(_at(gps, k)) for k in ("lat", "lon", "alt_m", "dop"))
    flag = F.when(dop.isNotNull(), "dop").when(F.coalesce(lat, lon, alt).isNotNull(), "unknown")
    algorithm, digest = _text(_at(v, "hash_algo")), F.when(_kind(_at(v, "hash_hex")) == "STRING", F.try_variant_get(v, "$.hash_hex", "string"))
    file = {"path": "string", "name": "string", "ext": "string", "size_bytes": "long"}
    named = lambda **fields: F.struct(*[c.alias(k) for k, c in fields.items()])
    return {
        "file": F.struct(*[F.try_variant_get(v, f"$.{k}", kind).alias(k) for k, kind in file.items()]),
        "os_times": F.when(os_times.isNotNull(), named(**{k: _number(_at(os_times, k)) for k in ("atime", "mtime", "ctime")})),
        "hashes": F.when(algorithm.isNotNull() & digest.isNotNull(), F.create_map(F.coalesce(algorithm, F.lit("")), digest)),
        "capture": named(make=_trimmed(_at(exif, "Make")), model=_trimmed(_at(exif, "Model")), software=software, datetime_original=_text(_at(exif_times, "DateTimeOriginal"))),
        "meta_times": named(
            digitized=_text(_at(exif_times, "DateTimeDigitized")),
            created=F.coalesce(_text(_at(pdf_times, "CreationDate")), _text(_at(docx_times, "created"))),
            modified=F.coalesce(_text(_at(pdf_times, "ModDate")), _text(_at(docx_times, "modified"))),
        ),
        "geo": named(lat=lat, lon=lon, alt_m=alt, gps_dop=dop, precision_flag=flag),
        "identity": named(author=F.coalesce(_trimmed(_at(docx, "creator")), _trimmed(_at(pdf, "Author"))), last_modified_by=_trimmed(_at(docx, "lastModifiedBy")), title=_trimmed(_at(docx, "title"))),
        "media": named(
            duration_sec=_number(_at(video, "duration_sec")), width=_positive(_at(video, "width")), height=_positive(_at(video, "height")),
            codec=_trimmed(_at(video, "codec")), container=_trimmed(_at(video, "container")), container_created=_text(_at(video, "container_created")),
        ),
    }


def normalize(raw: DataFrame) -> DataFrame:
    """Raw records in columns (path, name, ext, size_bytes, os_times, hash_algo, hash_hex, exif, exif_times, gps_norm, pdf, pdf_times, docx, docx_times, video; absent ones are null) as nine sections; raw has the columns themselves."""
    record = F.struct(*[F.col(f"`{c}`") for c in raw.columns])
    sections = normalized(F.col("__v"))
    return raw.select(record.alias("raw"), F.to_variant_object(record).alias("__v")).select(*[c.alias(k) for k, c in sections.items()], "raw")


def normalize_json(records: DataFrame, column: str = "raw") -> DataFrame:
    """Raw records as JSON texts; the other columns of records come before the sections (and give way to them where names clash). What isn't a JSON object has nothing but null in its sections."""
    sections = normalized(F.col("__v"))
    names = {*sections, "raw", column.lower(), "__v"}
    others = [F.col(f"`{c}`") for c in records.columns if c.lower() not in names]
    parsed = records.withColumn("__v", F.try_parse_json(F.col(f"`{column}`")))
    return parsed.select(*others, *[c.alias(k) for k, c in sections.items()], F.col(f"`{column}`").alias("raw"))
