"""File intake: kinds, guarded addresses, text decoding and append-only logs."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accepted extensions by kind.
KINDS = {"text": ("txt", "md", "markdown", "log"), "web": ("html", "htm"), "data": ("json", "csv", "tsv"), "office": ("doc", "docx", "ppt", "pptx", "xls", "xlsx", "rtf"), "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "bmp", "tif", "tiff")}
BY_EXTENSION = {e: k for k, v in KINDS.items() for e in v}


def classify(name: str, size: int, most: int = 50 << 20) -> str:
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext not in BY_EXTENSION:
        raise ValueError(f"files of kind {ext or 'none'} aren't accepted")
    if not 0 < size <= most:
        raise ValueError("the file is empty or too large")
    return BY_EXTENSION[ext]


def check_url(url: str, resolved: list[str] | None = None) -> str:
    """A public http(s) address; names are checked with the addresses that they resolve to."""
    u = urlsplit(url)
    if u.scheme not in ("http", "https") or not u.hostname or u.username or u.port not in (None, 80, 443):
        raise ValueError("not a plain http address")
    if u.hostname == "localhost" or u.hostname.endswith((".local", ".internal")):
        raise ValueError("not a public host")
    for a in resolved or [u.hostname]:
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            continue
        if not ip.is_global or ip.is_multicast:
            raise ValueError("not a public address")
    return url


def decode(raw: bytes) -> str:
    """UTF-16 by its mark, else UTF-8, else GBK, else UTF-8 with replacements."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for kind in ("utf-8-sig", "gbk"):
        try:
            return raw.decode(kind)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to an append-only log, with secrets hidden and long questions clipped."""
    hidden = F.regexp_replace("question", r"(?i)(password|token|secret|api_?key)(\s*[:=]\s*)\S+", "$1$2***")
    rows.withColumn("question", F.substring(hidden, 1, 2000)).write.mode("append").parquet(path)


def new_files(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """One row of each space and hash that isn't stored yet."""
    return incoming.dropDuplicates(["space", "sha256"]).join(stored.select("space", "sha256"), ["space", "sha256"], "left_anti")


def replaced(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored files after an upload: a name of a space with a new hash is shadowed by the new file, an equal one stays as it is.

    Both have space, name, sha256, version; a replaced file's version is one more, and active says which counts.
    """
    old = stored.select("space", "name", F.col("sha256").alias("_sha"), F.col("version").alias("_v"))
    last = old.groupBy("space", "name").agg(F.max_by("_sha", "_v").alias("_sha"), F.max("_v").alias("_v"))
    fresh = incoming.dropDuplicates(["space", "name"]).join(last, ["space", "name"], "left").where("_sha IS NULL OR sha256 <> _sha")
    every = stored.select("space", "name", "sha256", "version").unionByName(fresh.select("space", "name", "sha256", (F.coalesce("_v", F.lit(0)) + 1).alias("version")))
    return every.withColumn("active", F.col("version") == F.max("version").over(Window.partitionBy("space", "name")))
