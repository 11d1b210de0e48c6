"""Document table operators: media types, routing, record building
(J1, J2, P5-P10, P17).

The media-type dimension is bounded by the number of known types (a few
thousand at most, independent of the corpus), so it is broadcast explicitly;
everything else is a narrow projection of the document rows.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.ids import format_sid, pack_sid

MIN_VIDEO_SIZE = 1024 * 64  # fixed value: smaller videos are not media-parsed
MIN_IMAGE_SIZE = 512  # fixed value: smaller images are not media-parsed

# Media types per routing class.
RAW_TYPES = ["image/x-adobe-dng", "image/x-canon-cr2", "image/x-canon-crw", "image/x-dcraw", "image/x-epson-erf",
             "image/x-fuji-raf", "image/x-kodak-dcr", "image/x-kodak-k25", "image/x-kodak-kdc", "image/x-minolta-mrw",
             "image/x-nikon-nef", "image/x-olympus-orf", "image/x-panasonic-raw", "image/x-pentax-pef",
             "image/x-sigma-x3f", "image/x-sony-arw", "image/x-sony-sr2", "image/x-sony-srf"]
EBOOK_TYPES = ["application/pdf", "application/epub+zip"]
MARKUP_TYPES = ["text/html", "text/xml", "application/xml", "application/xhtml+xml"]
FONT_TYPES = ["application/x-font-ttf", "application/x-font-otf", "application/vnd.ms-fontobject"]
ARCHIVE_TYPES = ["application/zip", "application/x-tar", "application/gzip", "application/x-gzip",
                 "application/x-bzip2", "application/x-xz", "application/x-7z-compressed",
                 "application/x-rar", "application/vnd.rar"]
OFFICE_PREFIX = "application/vnd.openxmlformats-officedocument."
COMIC_TYPES = ["application/vnd.comicbook+zip", "application/vnd.comicbook-rar", "application/x-cbr",
               "application/x-cbz"]
MOBI_TYPES = ["application/x-mobipocket-ebook"]
MSDOC_TYPES = ["application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint"]
JSON_TYPES = ["application/json"]
NDJSON_TYPES = ["application/x-ndjson", "application/ndjson"]
EMPTY_MIME = "application/x-empty"  # fixed value: zero-byte files


def mime_dimension(spark: SparkSession) -> DataFrame:
    """(mime_id, extension, mime) of the types that Python itself defines;
    what the host's type files add is left out, so that ids and types are the
    same on every machine."""
    types = mimetypes.MimeTypes().types_map[True]
    rows = sorted({(ext.lstrip(".").lower(), t) for ext, t in types.items()})
    return spark.createDataFrame(
        [(i + 1, e, t) for i, (e, t) in enumerate(rows)], "mime_id int, extension string, mime string"
    )


def mime_by_extension(docs: DataFrame, mime_dim: DataFrame, ext_col: str = "extension",
                      name_col: str = "name", size_col: str = "size") -> DataFrame:
    """Lower-cased extension lookup (broadcast left join); size 0 gives
    the empty type; an empty extension or a leading-dot name gives NULL."""
    dim = F.broadcast(mime_dim.select(F.lower("extension").alias("_ext"), F.col("mime").alias("_mime")))
    joined = docs.join(dim, F.lower(F.col(ext_col)) == F.col("_ext"), "left")
    usable = (F.length(F.col(ext_col)) > 0) & (F.length(F.col(name_col)) > 0)
    mime = (F.when(F.col(size_col) == 0, F.lit(EMPTY_MIME))
            .when(usable, F.col("_mime")))
    return joined.withColumn("mime", mime).drop("_ext", "_mime")


def major_mime(mime) -> Column:
    """Part before '/'."""
    m = F.col(mime) if isinstance(mime, str) else mime
    return F.substring_index(m, "/", 1)


def file_class(mime: str = "mime", size: str = "size") -> Column:
    """Ordered routing of a document to a parser family."""
    m, s = F.col(mime), F.col(size)
    major = major_mime(m)
    return (
        F.when(m.isNull(), F.lit("none"))
        .when(m.isin(RAW_TYPES), F.lit("raw"))
        .when(((major == "video") & (s >= MIN_VIDEO_SIZE)) | ((major == "image") & (s >= MIN_IMAGE_SIZE))
              | (major == "audio"), F.lit("media"))
        .when(m.isin(EBOOK_TYPES), F.lit("ebook"))
        .when(m.isin(MARKUP_TYPES), F.lit("markup"))
        .when(major == "text", F.lit("text"))
        .when(m.isin(FONT_TYPES) | (major == "font"), F.lit("font"))
        .when(m.isin(ARCHIVE_TYPES), F.lit("archive"))
        .when(m.startswith(OFFICE_PREFIX), F.lit("office"))
        .when(m.isin(COMIC_TYPES), F.lit("comic"))
        .when(m.isin(MOBI_TYPES), F.lit("mobi"))
        .when(m.isin(MSDOC_TYPES), F.lit("msdoc"))
        .when(m.isin(JSON_TYPES), F.lit("json"))
        .when(m.isin(NDJSON_TYPES), F.lit("ndjson"))
        .otherwise(F.lit("none"))
    )


def typed_documents(docs: DataFrame, mime_dim: DataFrame, ext_col: str = "extension") -> DataFrame:
    """Only documents whose extension has a known media type (inner join)."""
    dim = F.broadcast(mime_dim.select(F.lower("extension").alias("_ext"), F.col("mime")))
    base = docs.drop("mime") if "mime" in docs.columns else docs
    return base.join(dim, F.lower(F.col(ext_col)) == F.col("_ext"), "inner").drop("_ext")


def index_documents(corpus: DataFrame, mime_dim: DataFrame) -> DataFrame:
    """Search-index rows: the corpus with its media type and packed id."""
    return mime_by_extension(corpus, mime_dim).withColumn("sid", pack_sid("index_id", "id"))


def json_record(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Documents as (id, json_data) text, the stored record form."""
    return docs.select("id", F.to_json(F.struct(*fields)).alias("json_data"))


def json_get(json_col: str, key: str) -> Column:
    """``json_data ->> key``."""
    return F.get_json_object(F.col(json_col), f"$.{key}")


def hit_source(docs: DataFrame, vector_ids: DataFrame, fields: list[str]) -> DataFrame:
    """Result record without content: fields plus _id (formatted packed id),
    index, thumbnail, mime, size and an embedding 0/1 flag from a left join to
    the distinct ids that have vectors."""
    flags = vector_ids.select(F.col("id").alias("_vid")).distinct()
    joined = docs.join(flags, docs["id"] == flags["_vid"], "left")
    src = F.struct(
        *[F.col(f) for f in fields],
        format_sid(pack_sid("index_id", "id")).alias("_id"),
        F.col("index_id").alias("index"),
        F.col("thumbnail_count").alias("thumbnail"),
        F.col("mime"),
        F.col("size"),
        F.when(F.col("_vid").isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("embedding"),
    )
    return joined.select("id", F.to_json(src).alias("source"))


def get_documents(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """P10: stored records of a set of ids (semi join)."""
    return docs.join(ids.select(id_col), id_col, "left_semi")


# What a browser does not show or play.
UNPLAYABLE_EXTENSIONS = ["mkv", "avi", "mov"]
UNPLAYABLE_VIDEO_CODECS = ["hevc", "mpeg1video", "mpeg2video", "wmv3"]
UNPLAYABLE_IMAGE_CODECS = ["tiff", "raw", "ppm"]


def hit_props(df: DataFrame) -> DataFrame:
    """Derived display flags of a hit."""
    cols = set(df.columns)

    def has(c):
        return F.col(c).isNotNull() if c in cols else F.lit(False)

    def val(c):
        return F.col(c) if c in cols else F.lit(None)

    sub = has("parent")
    cat = major_mime("mime")
    thumb = F.coalesce(val("thumbnail_count").cast("long"), F.lit(0)) if "thumbnail_count" in cols else F.lit(0)
    videoc = val("videoc")
    ext = val("extension")
    is_image = (cat == "image") & (F.coalesce(videoc, F.lit("")) != "gif")
    is_video = (cat == "video") & has("videoc")
    playable_video = is_video & F.col("mime").startswith("video/") & ~sub & \
        ~F.coalesce(ext, F.lit("")).isin(UNPLAYABLE_EXTENSIONS) & \
        ~F.coalesce(videoc, F.lit("")).isin(UNPLAYABLE_VIDEO_CODECS)
    playable_image = (cat == "image") & has("width") & ~sub & ~F.coalesce(videoc, F.lit("")).isin(UNPLAYABLE_IMAGE_CODECS)
    aspect = F.when((cat == "image") & has("width") & has("height"),
                    F.round(val("width").cast("double") / val("height").cast("double"), 6))
    return df.select(
        "id",
        sub.alias("is_sub_document"),
        (thumb > 0).alias("has_thumbnail"),
        (thumb > 1).alias("has_vid_preview"),
        F.coalesce(is_image, F.lit(False)).alias("is_image"),
        F.coalesce((cat == "image") & (F.coalesce(videoc, F.lit("")) == "gif"), F.lit(False)).alias("is_gif"),
        F.coalesce(playable_image, F.lit(False)).alias("is_playable_image"),
        aspect.alias("image_aspect_ratio"),
        F.coalesce(is_video, F.lit(False)).alias("is_video"),
        F.coalesce(playable_video, F.lit(False)).alias("is_playable_video"),
        F.coalesce((cat == "audio") & has("audioc") & ~sub, F.lit(False)).alias("is_audio"),
    )
