"""Registered rule-tagging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.operators import rules as R
from docsift.operators import scripts as X
from docsift.plans.registry import query
from docsift.sources.fixtures import Fixtures, with_fixtures

YEAR_SQL = r"regexp_extract(name, '[\(\.+](20[0-9]{2})[\)\.+]', 1)"
CODE_RE = "([A-Z]{4})-[0-9]{3} (.*)"
APERTURE_SQL = """'Aperture.f/' || CASE WHEN q IS NULL OR isnan(q) THEN '0,0' ELSE replace(CAST(q AS VARCHAR), '.', ',') END"""
APERTURE_Q = ("CAST(TRY_CAST(string_split(exif_fnumber, ' ')[1] AS FLOAT) / "
              "TRY_CAST(string_split(exif_fnumber, ' ')[2] AS FLOAT) AS FLOAT)")
TS_SQL = "try_strptime(exif_datetime, '%Y:%m:%d %H:%M:%S')"

GENRE_SQL = "SELECT id, 'genre.' || lower(genre) AS tag FROM meta WHERE genre IS NOT NULL"
AUTHOR_SQL = ("SELECT id, 'author.' || trim(string_split(name, '-')[2], ' ') AS tag FROM meta "
              "WHERE contains(name, '-') AND extension = 'pdf'")
CODES_SQL = f"""SELECT id, 'studio.' || regexp_extract(code_name, '{CODE_RE}', 1) AS tag FROM meta
  WHERE regexp_matches(code_name, '{CODE_RE}')
UNION ALL SELECT id, 'actress.' || unnest(string_split(regexp_extract(code_name, '{CODE_RE}', 2), ',')) AS tag
  FROM meta WHERE regexp_matches(code_name, '{CODE_RE}')"""
APERTURE_FULL = (f"SELECT id, {APERTURE_SQL} AS tag FROM (SELECT id, {APERTURE_Q} AS q FROM meta "
                 f"WHERE exif_fnumber IS NOT NULL)")
MONTH_SQL = f"""SELECT id, 'Month.' || strftime({TS_SQL}, '%B') AS tag FROM meta WHERE {TS_SQL} IS NOT NULL
UNION ALL SELECT id, 'Year.' || strftime({TS_SQL}, '%Y') AS tag FROM meta WHERE {TS_SQL} IS NOT NULL"""


def _run(spark, sf_dir, table, rules):
    df = getattr(Fixtures(spark, sf_dir), table)
    return R.apply_script(df, rules)


@query("tag_genre", "X2", with_fixtures(["meta"], GENRE_SQL))
def tag_genre(spark, sf_dir):
    return _run(spark, sf_dir, "meta", [R.tag_genre])


@query("tag_year", "X3", with_fixtures(["corpus"], f"""
SELECT id, 'year.' || {YEAR_SQL} AS tag FROM corpus WHERE {YEAR_SQL} <> ''"""))
def tag_year(spark, sf_dir):
    return _run(spark, sf_dir, "corpus", [R.tag_year])


@query("tag_author", "X4", with_fixtures(["meta"], AUTHOR_SQL))
def tag_author(spark, sf_dir):
    return _run(spark, sf_dir, "meta", [R.tag_author])


@query("tag_code_and_names", "X5", with_fixtures(["meta"], f"SELECT DISTINCT id, tag FROM ({CODES_SQL})"))
def tag_code_and_names(spark, sf_dir):
    return _run(spark, sf_dir, "meta", "code_names")


@query("tag_last_folder", "X6", with_fixtures(["corpus"], """
SELECT id, 'studio.' || string_split(path, '/')[-1] AS tag FROM corpus WHERE path <> ''"""))
def tag_last_folder(spark, sf_dir):
    return _run(spark, sf_dir, "corpus", [R.tag_last_folder])


@query("tag_aperture", "X7", with_fixtures(["meta"], APERTURE_FULL))
def tag_aperture(spark, sf_dir):
    return _run(spark, sf_dir, "meta", [R.tag_aperture])


@query("tag_year_month", "X8", with_fixtures(["meta"], MONTH_SQL))
def tag_year_month(spark, sf_dir):
    return _run(spark, sf_dir, "meta", [R.tag_year_month])


@query("tag_constant", "X9", with_fixtures(["corpus"], "SELECT id, 'reviewed.#00ff00' AS tag FROM corpus"))
def tag_constant(spark, sf_dir):
    return _run(spark, sf_dir, "corpus", [lambda: R.tag_constant("reviewed.#00ff00")])


@query("apply_script", "X1", with_fixtures(["meta"], f"""
SELECT DISTINCT id, tag FROM (
  {GENRE_SQL}
  UNION ALL {AUTHOR_SQL}
  UNION ALL {CODES_SQL}
  UNION ALL {APERTURE_FULL}
  UNION ALL {MONTH_SQL}
  UNION ALL SELECT id, 'batch.#2196f3' AS tag FROM meta)"""))
def apply_script(spark, sf_dir):
    rules = [R.tag_genre, R.tag_author, lambda: R.tag_code_and_names("code_name"), R.tag_aperture,
             R.tag_year_month, lambda: R.tag_constant("batch.#2196f3")]
    return _run(spark, sf_dir, "meta", rules).select("id", F.col("tag"))


@query("apply_record_script", "X1", with_fixtures(["meta"], """
SELECT id, upper(name) || ' (' || extension || ')' AS name, genre, CAST(width * height AS BIGINT) AS pixels,
       CASE WHEN genre IS NULL THEN 'artist,code_name,exif_datetime,extension,gps_latitude_dms,gps_latitude_ref,height,media,mime,name,size,tag,videoc,width'
            ELSE 'artist,code_name,exif_datetime,extension,genre,gps_latitude_dms,gps_latitude_ref,height,media,mime,name,size,tag,videoc,width' END AS keys,
       'big.#ff8800,' || CASE WHEN genre IS NULL THEN '' ELSE 'genre.' || genre || ',' END || 'seen.#00ff00' AS tags
FROM meta WHERE width * height >= 480 * 64 * 20
UNION ALL
SELECT id, name, genre, NULL, CASE WHEN genre IS NULL THEN 'artist,code_name,exif_datetime,exif_fnumber,extension,gps_latitude_dms,gps_latitude_ref,height,mime,name,size,videoc,width'
            ELSE 'artist,code_name,exif_datetime,exif_fnumber,extension,genre,gps_latitude_dms,gps_latitude_ref,height,mime,name,size,tag,videoc,width' END,
       CASE WHEN genre IS NOT NULL THEN 'genre.' || genre END
FROM meta WHERE width * height < 480 * 64 * 20"""))
def apply_record_script(spark, sf_dir):
    """A script that sets, removes and reads keys of the record, and its tags."""
    meta = Fixtures(spark, sf_dir).meta
    own = meta.where(F.col("genre").isNotNull()).select("id", F.concat(F.lit("genre."), "genre").alias("tag"))

    def script(records):
        n = X.get_key("record", "width", "long") * X.get_key("record", "height", "long")
        name = F.concat(F.upper(X.get_key("record", "name")), F.lit(" ("), X.get_key("record", "extension"), F.lit(")"))
        rec = X.remove_key(X.set_key(X.set_key("record", "name", name), "media.pixels", n), "exif_fnumber")
        return records.where(n >= 480 * 64 * 20).select("id", X.add_tags(rec, F.array(F.lit("seen.#00ff00"), F.lit("big.#ff8800"))).alias("record"))

    records, _ = X.run_script(X.as_records(meta, own), script)
    tags = X.record_tags(records).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    out = records.select("id", X.get_key("record", "name").alias("name"), X.get_key("record", "genre").alias("genre"),
                         X.get_key("record", "media.pixels", "long").alias("pixels"),
                         F.array_join(F.array_sort(F.map_keys(X.members("record"))), ",").alias("keys"))
    return out.join(tags, "id", "left")
