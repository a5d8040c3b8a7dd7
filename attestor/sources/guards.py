"""Guards in front of the readers: URLs that may be fetched, uploads that may come in, and what a file really is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import basename

UPLOADS, UPLOAD_BYTES, TOTAL_BYTES = 20, 50 * 1024 * 1024, 200 * 1024 * 1024

# Hosts that are never public, and ranges of addresses as patterns.
LOCAL_HOSTS = ("localhost", "localhost.localdomain", "ip6-localhost", "metadata.google.internal")
LOCAL_ENDS = r"\.(local|localhost|internal|lan|home)$"
PRIVATE_V4 = (
    r"^(0|10|127)\.", r"^169\.254\.", r"^192\.168\.", r"^192\.0\.[02]\.", r"^172\.(1[6-9]|2\d|3[01])\.", r"^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.",
    r"^198\.(1[89]|51\.100)\.", r"^203\.0\.113\.", r"^(22[4-9]|23\d|24\d|25[0-5])\.",
)
PRIVATE_V6 = r"^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|::ffff:.*)\]?$"
# First bytes of file kinds, in hexadecimal.
MAGIC = {"pdf": "25504446", "zip": "504B0304", "png": "89504E47", "jpg": "FFD8FF", "gif": "47494638", "xls": "D0CF11E0", "gz": "1F8B"}
SUFFIX_MAGIC = {".pdf": "pdf", ".xlsx": "zip", ".xls": "xls", ".png": "png", ".jpg": "jpg", ".jpeg": "jpg", ".gif": "gif", ".gz": "gz", ".zip": "zip"}


def url_problem(url: Column) -> Column:
    """Why a URL must not be fetched, or null: only http and https, no user part, no local names, no private addresses."""
    text = F.trim(url)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    odd = host.rlike(r"^(0x[0-9a-f]+|\d+)$") | host.rlike(r"^(0\d+|0x[0-9a-f]+)\.")
    private = host.rlike("|".join(PRIVATE_V4)) & host.rlike(r"^\d+(\.\d+){3}$")
    return (
        F.when(~scheme.isin("http", "https"), "scheme is not http or https")
        .when(host == "", "no host")
        .when(F.contains(authority, F.lit("@")), "user information in the URL")
        .when(host.isin(*LOCAL_HOSTS) | host.rlike(LOCAL_ENDS), "local host")
        .when(private | odd | host.rlike(PRIVATE_V6), "private or reserved address")
    )


def sniffed(content: Column) -> Column:
    """The kind of a file by its first bytes; ``html`` or ``text`` where it reads as such, else ``unknown``."""
    head, choice = F.hex(F.substring(content, 1, 8)), None
    for kind, magic in MAGIC.items():
        hit = F.startswith(head, F.lit(magic))
        choice = F.when(hit, kind) if choice is None else choice.when(hit, kind)
    text = F.lower(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"))
    return choice.when(text.rlike(r"<(!doctype html|html|head|body)"), "html").when(~F.contains(text, F.lit("\u0000")), "text").otherwise("unknown")


def content_problem(path: Column, content: Column) -> Column:
    """Why a file's content does not fit its ending, or null; endings without a mark of their own fit anything but a web page."""
    end = F.regexp_extract(F.lower(basename(path)), r"(\.[a-z0-9]+)$", 1)
    wanted, found = F.element_at(F.create_map(*(F.lit(x) for p in SUFFIX_MAGIC.items() for x in p)), end), sniffed(content)
    return F.when(F.length(content) == 0, "empty file").when(wanted.isNotNull() & (wanted != found), F.concat(F.lit("content is "), found, F.lit(", not "), wanted))


def admit(uploads: DataFrame, count: int = UPLOADS, each: int = UPLOAD_BYTES, total: int = TOTAL_BYTES) -> DataFrame:
    """Add ``problem``, null for uploads that may come in: (request_id, ordinal, path, length, content) checked in order.

    A request has at most ``count`` files, of ``each`` bytes at most and ``total`` together; contents must fit the endings.
    """
    order = Window.partitionBy("request_id").orderBy("ordinal")
    placed = uploads.withColumns({"_n": F.row_number().over(order), "_sum": F.sum("length").over(order)})
    problem = (
        F.when(F.col("_n") > count, "too many files")
        .when(F.col("length") > each, "file too large")
        .when(F.col("_sum") > total, "request too large")
        .otherwise(content_problem(F.col("path"), F.col("content")))
    )
    return placed.withColumn("problem", problem).drop("_n", "_sum")


def public_row(rows: DataFrame, hidden: tuple[str, ...] = ("local_path", "source_path", "downloaded_path")) -> DataFrame:
    """Rows without local paths: path columns go, paths inside of texts become their last part."""
    kept = rows.drop(*hidden)
    texts = [c for c, t in kept.dtypes if t == "string"]
    return kept.withColumns({c: F.regexp_replace(c, r"(?<![\w:/])(?:/[\w.-]+){2,}/([\w.-]+)", "$1") for c in texts})
