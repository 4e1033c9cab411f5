"""Schemas and key sets of the scan data model."""

from __future__ import annotations

SCAN = "path string, mime string, size_bytes long, sha256 string, metadata string, warnings array<string>, errors array<string>"

# Keys that hold private facts, and keys that place a file in time.
PRIVACY_KEYS = ("gps_latitude", "gps_longitude", "exif_datetime_original", "pdf_author", "docx_author")
TIMELINE_KEYS = ("exif_datetime_original", "mtime")
# Media types by suffix; anything else is OTHER_MIME.
MIME_BY_SUFFIX = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".mp4": "video/mp4", ".mov": "video/mp4", ".m4v": "video/mp4",
}
OTHER_MIME = "application/octet-stream"
