"""Queries over settings, thresholds, phases, progress and file lists, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filelist, phases, settings, thresholds
from ..streaming import progress
from . import fixtures

C = thresholds.CROWNS


def _rows(spark, sf_dir: str, name: str) -> DataFrame:
    return fixtures.rows(spark, sf_dir, getattr(fixtures, name))


def _pairs(spark, sf_dir):
    """Of the lines of many files."""
    return settings.parse(_rows(spark, sf_dir, "LINES"), ["file"])


def _each_file(spark, sf_dir, rows: list[tuple], *names: str) -> DataFrame:
    """The rows for each file."""
    files = _rows(spark, sf_dir, "LINES").select("file").distinct()
    return files.select("file", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in rows))).alias("x")).select("file", "x.*")


def _lists(spark, sf_dir):
    return _rows(spark, sf_dir, "LISTS").select("id", "tops", "crowns", thresholds.parse(F.col("tops")).alias("t"), thresholds.parse(F.col("crowns"), C).alias("c"))


def _flat(df: DataFrame, items: str, fields=thresholds.TOPS) -> DataFrame:
    return df.select("id", F.posexplode(items).alias("nth", "x")).select("id", "nth", *(F.col(f"x.{n}").alias(n) for n, _ in fields))


def settings_parse(spark, sf_dir):
    return _pairs(spark, sf_dir)


def settings_format(spark, sf_dir):
    return settings.to_lines(_pairs(spark, sf_dir))


def settings_geti(spark, sf_dir):
    return _pairs(spark, sf_dir).select("file", "key", settings.as_int(F.col("value"), 7).alias("n"))


def settings_getf(spark, sf_dir):
    return _pairs(spark, sf_dir).select("file", "key", settings.as_double(F.col("value")).alias("x"))


def settings_getb(spark, sf_dir):
    return _pairs(spark, sf_dir).select("file", "key", settings.as_bool(F.col("value")).alias("b"))


def settings_gets(spark, sf_dir):
    wanted = _each_file(spark, sf_dir, [(f"path{i}",) for i in range(60)], "key")
    return wanted.join(_pairs(spark, sf_dir), ["file", "key"], "left").select("file", "key", settings.as_string(F.col("value"), "none").alias("s"))


def _named(spark, sf_dir) -> DataFrame:
    """Pairs whose keys are mapped onto known ones."""
    named = _each_file(spark, sf_dir, [(k, f"path{2 * i}") for i, k in enumerate(settings.KEYS)], "known", "key")
    return _pairs(spark, sf_dir).join(named, ["file", "key"]).select("file", F.col("known").alias("key"), "value")


def settings_load(spark, sf_dir):
    """The known keys get values from each file; the others keep what they have."""
    current = _each_file(spark, sf_dir, [(k, f"old{i}") for i, k in enumerate(settings.KEYS)], "key", "value")
    return settings.load(_named(spark, sf_dir), current, ["file"])


def settings_on_existing(spark, sf_dir):
    """Both choices, side by side."""
    old = _each_file(spark, sf_dir, [(k, f"old{i}") for i, k in enumerate(settings.KEYS)], "key", "value")
    new = _each_file(spark, sf_dir, [(k, "") for k in settings.KEYS], "key", "value")
    both = [settings.on_existing(_named(spark, sf_dir), old, new, choice, ["file"]).withColumn("choice", F.lit(choice)) for choice in ("open", "reset")]
    return both[0].unionByName(both[1])


def settings_save(spark, sf_dir):
    typed = fixtures.rows(spark, sf_dir, "SELECT c_custkey AS id, c_custkey % 2 = 0 AS doSmoothing, CAST(c_custkey % 9 AS INT) AS smoothWindowSize, c_acctbal AS smoothSigma, c_name AS originalCHM FROM customer")
    return settings.save(typed)


def thresholds_parse(spark, sf_dir):
    return _flat(_lists(spark, sf_dir), "c", C)


def thresholds_format(spark, sf_dir):
    return _lists(spark, sf_dir).select("id", thresholds.to_text(F.col("t")).alias("tops"), thresholds.to_text(F.col("c"), C).alias("crowns"))


def thresholds_valid_tops(spark, sf_dir):
    return _lists(spark, sf_dir).select("id", thresholds.valid_tops(F.col("t")).alias("ok"))


def thresholds_valid_crowns(spark, sf_dir):
    return _lists(spark, sf_dir).select("id", thresholds.valid_crowns(F.col("c")).alias("ok"))


def thresholds_add(spark, sf_dir):
    return _flat(_lists(spark, sf_dir).withColumn("t", thresholds.add(F.col("t"))), "t")


def thresholds_delete(spark, sf_dir):
    return _flat(_lists(spark, sf_dir).withColumn("t", thresholds.delete(F.col("t"), F.col("id") % 3)), "t")


def thresholds_update(spark, sf_dir):
    new = thresholds.record(thresholds.TOPS, F.col("id") * 0.5, F.lit(9))
    return _flat(_lists(spark, sf_dir).withColumn("t", thresholds.update(F.col("t"), F.col("id") % 3, new)), "t")


def thresholds_order(spark, sf_dir):
    """Items stand in the order of the list, not of their heights."""
    return _flat(_lists(spark, sf_dir), "t")


def thresholds_sort(spark, sf_dir):
    return _flat(_lists(spark, sf_dir).withColumn("t", thresholds.ordered(F.col("t"))), "t")


def _switches(spark, sf_dir):
    return fixtures.rows(spark, sf_dir, "SELECT c_custkey AS id, c_custkey % 2 = 0 AS s, c_custkey % 3 = 0 AS t, c_custkey % 5 = 0 AS c, c_custkey % 7 < 5 AS d, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name FROM customer")


def phase_dependency(spark, sf_dir):
    t, c = F.col("t"), F.col("c")
    return _switches(spark, sf_dir).select("id", phases.after_tops(t, c).alias("crowns"), phases.after_crowns(t, c).alias("tops"))


def option_enable(spark, sf_dir):
    return _switches(spark, sf_dir).select("id", phases.shape_options(F.col("c"), F.col("d")).alias("ok"))


def can_run(spark, sf_dir):
    joined = _switches(spark, sf_dir).join(_lists(spark, sf_dir).select("id", F.col("t").alias("tl"), F.col("c").alias("cl")), "id")
    name = F.col("name")
    return joined.select("id", phases.can_run(F.col("s"), F.col("t"), F.col("c"), F.lit("chm.tif"), name, F.lit("tops.sqlite"), F.when(F.col("d"), name), thresholds.valid_tops(F.col("tl")), thresholds.valid_crowns(F.col("cl"))).alias("ok"))


def change_mask(spark, sf_dir):
    masks = fixtures.rows(spark, sf_dir, "SELECT c_custkey AS id, (c_custkey * 7919) % 131072 AS mask FROM customer")
    return masks.select("id", F.array_join(phases.changed(F.col("mask")), " ").alias("flags"))


def _files(spark, sf_dir):
    return _rows(spark, sf_dir, "FILES")


def driver_reset(spark, sf_dir):
    driver = F.when(F.col("id") % 3 == 0, "GTiff").when(F.col("id") % 3 == 1, "SQLite").otherwise("ESRI Shapefile")
    return _files(spark, sf_dir).select("id", settings.driver_after(F.col("path"), driver).alias("driver"))


def default_outputs(spark, sf_dir):
    driver = F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.lit("HFA"))
    return _files(spark, sf_dir).select("id", settings.default_outputs(F.col("path"), driver).alias("o")).select("id", "o.*")


def last_dir(spark, sf_dir):
    path = F.when(F.col("id") % 4 == 0, F.lit("/data/plain")).otherwise(F.col("path"))
    return _files(spark, sf_dir).select("id", settings.last_dir(path).alias("dir"))


def raster_drivers(spark, sf_dir):
    return settings.drivers(spark, "raster")


def vector_drivers(spark, sf_dir):
    return settings.drivers(spark, "vector")


def progress_round(spark, sf_dir):
    return _rows(spark, sf_dir, "PROGRESS").where("status >= 0").select("run", "seq", progress.percent(F.col("status")).alias("percent"))


def progress_ffill(spark, sf_dir):
    return progress.filled(_rows(spark, sf_dir, "PROGRESS")).select("run", "seq", "status")


def message_ffill(spark, sf_dir):
    return progress.filled(_rows(spark, sf_dir, "PROGRESS")).select("run", "seq", "message")


def strip_prefix(spark, sf_dir):
    said = fixtures.rows(spark, sf_dir, "SELECT c_custkey AS id, concat(CASE c_custkey % 3 WHEN 0 THEN 'boost::io_error ' WHEN 1 THEN 'boost::alone' ELSE 'plain ' END, c_name) AS text FROM customer")
    return said.select("id", settings.strip_prefix(F.col("text")).alias("text"))


def filelist_add(spark, sf_dir):
    f = _files(spark, sf_dir)
    return filelist.add(f.where("id % 2 = 0").select("path"), f.where("id % 3 = 0").select("path"))


def filelist_remove(spark, sf_dir):
    f = _files(spark, sf_dir)
    return filelist.remove(f.select("path"), f.where("id % 3 = 0").select("path"))


def filelist_clear(spark, sf_dir):
    return filelist.clear(_files(spark, sf_dir).select("path"))


def filelist_read(spark, sf_dir):
    return filelist.read(_files(spark, sf_dir))


def filelist_set(spark, sf_dir):
    f = _files(spark, sf_dir)
    return filelist.replace(f.where("id % 2 = 0"), f.where("id % 3 = 0"))


def file_filter(spark, sf_dir):
    return _files(spark, sf_dir).select("id", settings.file_kind(F.col("path")).alias("kind"))


QUERIES = {f.__name__: f for f in (
    settings_parse, settings_format, settings_geti, settings_getf, settings_getb, settings_gets, settings_load, settings_on_existing, settings_save, thresholds_parse, thresholds_format, thresholds_valid_tops, thresholds_valid_crowns,
    thresholds_add, thresholds_delete, thresholds_update, thresholds_order, thresholds_sort, phase_dependency, option_enable, can_run, change_mask, driver_reset, default_outputs, last_dir, raster_drivers, vector_drivers,
    progress_round, progress_ffill, message_ffill, strip_prefix, filelist_add, filelist_remove, filelist_clear, filelist_set, filelist_read, file_filter,
)}


# The same in SQL.

_PAIR = "'([^:]*):([^\\n]*)\\n'"
_LINES = f"""WITH l AS ({fixtures.duck_sql(fixtures.LINES)}), t AS (SELECT file, coalesce(string_agg(value || chr(10), '' ORDER BY line_no), '') AS t FROM l GROUP BY file),
  u AS (SELECT file, regexp_extract_all(t, {_PAIR}, 1) AS k, regexp_extract_all(t, {_PAIR}, 2) AS v, regexp_replace(t, {_PAIR}, '', 'g') AS rest FROM t),
  o AS (SELECT file, CASE WHEN rest = '' THEN k ELSE list_append(k, rest) END AS k, CASE WHEN rest = '' THEN v ELSE list_append(v, '') END AS v FROM u),
  q AS (SELECT file, unnest(k) AS key, unnest(v) AS value, unnest(range(1, len(k) + 1)) AS n FROM o),
  e AS (SELECT file, min(n) AS last FROM q WHERE length(key) > 1023 OR length(value) > 1023 GROUP BY file),
  p AS (SELECT file, left(key, 1023) AS key, arg_max(CASE WHEN length(key) > 1023 THEN '' ELSE left(value, 1023) END, n) AS value FROM q LEFT JOIN e USING (file) WHERE n <= coalesce(last, n) GROUP BY 1, 2),
  f AS (SELECT DISTINCT file FROM l)"""
_T = "[{'threshold': x[2 * i + 1]::DOUBLE, 'window': x[2 * i + 2]::INTEGER} FOR i IN range(len(x) // 2)]"
_C = "[{'threshold': y[3 * i + 1]::DOUBLE, 'fraction': y[3 * i + 2]::DOUBLE, 'radius': y[3 * i + 3]::DOUBLE} FOR i IN range(len(y) // 3)]"
_LISTS = "WITH r AS (" + fixtures.duck_sql(fixtures.LISTS) + f"), z AS (SELECT *, string_split(tops, ',') AS x, string_split(crowns, ',') AS y FROM r), v AS (SELECT id, tops, crowns, {_T} AS t, {_C} AS c FROM z)"
_SWITCH = "WITH w AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS s, c_custkey % 3 = 0 AS t, c_custkey % 5 = 0 AS c, c_custkey % 7 < 5 AS d, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name FROM customer)"
_FILES = "WITH f AS (" + fixtures.duck_sql(fixtures.FILES) + ")"
_PROGRESS = "WITH e AS (" + fixtures.duck_sql(fixtures.PROGRESS) + ")"
_OK_T = "len({0}) > 0 AND len(list_filter({0}, lambda q: NOT (q.threshold > 0 AND q.window >= 3 AND q.window % 2 = 1))) = 0"
_OK_C = "len({0}) > 0 AND len(list_filter({0}, lambda q: NOT (q.fraction > 0 AND q.radius > 0 AND q.threshold > 0))) = 0"


def _items(list_: str, fields=("threshold", "window")) -> str:
    parts = ", ".join(f'x."{n}" AS "{n}"' for n in fields)
    return f"{_LISTS}, i AS (SELECT id, unnest({list_}) AS x, generate_subscripts({list_}, 1)::INTEGER - 1 AS nth FROM v) SELECT id, nth, {parts} FROM i"


_KNOWN = ", ".join(f"({i}, '{k}')" for i, k in enumerate(settings.KEYS))
_NUMBER = "regexp_replace({}::VARCHAR, '\\.0$', '')"

ORACLES = {
    "settings_parse": f"{_LINES} SELECT file, key, value FROM p",
    "settings_format": f"{_LINES} SELECT file, key || ':' || value AS line FROM p",
    "settings_geti": f"{_LINES} SELECT file, key, least(greatest(coalesce(try_cast(regexp_extract(value, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0), -2147483648), 2147483647)::INTEGER AS n FROM p",
    "settings_getf": f"{_LINES} SELECT file, key, coalesce(try_cast(regexp_extract(value, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE), 0.0) AS x FROM p",
    "settings_getb": f"{_LINES} SELECT file, key, substr(value, 1, 1) IN ('t', 'T', '1') AS b FROM p",
    "settings_gets": f"{_LINES} SELECT f.file, 'path' || i AS key, coalesce(value, 'none') AS s FROM f CROSS JOIN range(60) x(i) LEFT JOIN p ON p.file = f.file AND p.key = 'path' || i",
    "settings_load": f"{_LINES} SELECT f.file, k.key, CASE WHEN k.key = 'settingsFile' THEN 'old' || i WHEN k.key IN ('topsThresholds', 'crownsThresholds') THEN coalesce(p.value, '') ELSE coalesce(p.value, 'old' || i) END AS value FROM f CROSS JOIN (VALUES {_KNOWN}) k(i, key) LEFT JOIN p ON p.file = f.file AND p.key = 'path' || (i * 2)",
    "settings_on_existing": f"{_LINES} SELECT *, 'open' AS choice FROM (SELECT f.file, k.key, CASE WHEN k.key = 'settingsFile' THEN 'old' || i WHEN k.key IN ('topsThresholds', 'crownsThresholds') THEN coalesce(p.value, '') ELSE coalesce(p.value, 'old' || i) END AS value FROM f CROSS JOIN (VALUES {_KNOWN}) k(i, key) LEFT JOIN p ON p.file = f.file AND p.key = 'path' || (i * 2)) UNION ALL SELECT f.file, key, '', 'reset' FROM f CROSS JOIN (VALUES {_KNOWN}) k(i, key)",
    "settings_save": """SELECT c_custkey AS id, unnest(['originalCHM:' || c_name, 'doSmoothing:' || CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END, 'smoothWindowSize:' || (c_custkey % 9),
      'smoothSigma:' || format('{:.6f}', c_acctbal)]) AS line FROM customer""",
    "thresholds_parse": _items("c", ("threshold", "fraction", "radius")),
    "thresholds_format": f"{_LISTS} SELECT id, array_to_string([{_NUMBER.format('q.threshold')} || ',' || q.window FOR q IN t], ',') AS tops, array_to_string([{_NUMBER.format('q.threshold')} || ',' || {_NUMBER.format('q.fraction')} || ',' || {_NUMBER.format('q.radius')} FOR q IN c], ',') AS crowns FROM v",
    "thresholds_valid_tops": f"{_LISTS} SELECT id, {_OK_T.format('t')} AS ok FROM v",
    "thresholds_valid_crowns": f"{_LISTS} SELECT id, {_OK_C.format('c')} AS ok FROM v",
    "thresholds_add": _items("list_append(t, {'threshold': 0.0::DOUBLE, 'window': 0})"),
    "thresholds_delete": _items("list_filter(t, lambda q, i: i - 1 <> id % 3)"),
    "thresholds_update": _items("list_transform(t, lambda q, i: CASE WHEN i - 1 = id % 3 THEN {'threshold': id * 0.5::DOUBLE, 'window': 9} ELSE q END)"),
    "thresholds_order": _items("t"),
    "thresholds_sort": f"{_LISTS}, i AS (SELECT id, unnest(t) AS x, generate_subscripts(t, 1) AS nth_in FROM v) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY x.threshold, nth_in) - 1)::INTEGER AS nth, x.threshold AS threshold, x.window AS \"window\" FROM i",
    "phase_dependency": f"{_SWITCH} SELECT id, t AND c AS crowns, t OR c AS tops FROM w",
    "option_enable": f"{_SWITCH} SELECT id, c AND d AS ok FROM w",
    "can_run": _LISTS.replace("WITH r", _SWITCH + ", r", 1) + f""" SELECT id, (s OR w.t OR w.c) AND (NOT s OR name <> '') AND (NOT w.t OR name <> '' AND {_OK_T.format('v.t')}) AND (NOT w.c OR name <> '' AND d AND {_OK_C.format('v.c')}) AS ok
      FROM w JOIN v USING (id)""",
    "change_mask": f"SELECT c_custkey AS id, array_to_string([n FOR n, i IN {list(phases.FLAGS)!r} IF ((c_custkey * 7919) % 131072) // (1 << (i - 1)) % 2 = 1], ' ') AS flags FROM customer",
    "driver_reset": f"""{_FILES}, g AS (SELECT id, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS e, CASE id % 3 WHEN 0 THEN 'GTiff' WHEN 1 THEN 'SQLite' ELSE 'ESRI Shapefile' END AS n FROM f)
      SELECT id, CASE WHEN n = 'GTiff' AND e IN ('tif', 'tiff') OR n = 'SQLite' AND e = 'sqlite' OR n = 'ESRI Shapefile' AND e = 'shp' THEN n ELSE '' END AS driver FROM g""",
    "default_outputs": f"""{_FILES}, g AS (SELECT id, regexp_replace(path, '\\.[^./]*$', '') AS s FROM f) SELECT id, s || '_smoothed.tif' AS smoothed, s || '_tops.sqlite' AS tops, s || '_crowns.tif' AS crowns_raster,
      s || '_crowns.sqlite' AS crowns_database, CASE id % 2 WHEN 0 THEN 'GTiff' ELSE 'HFA' END AS driver FROM g""",
    "last_dir": f"{_FILES} SELECT id, CASE WHEN id % 4 = 0 THEN '/data/plain' ELSE regexp_replace(path, '/[^/]*$', '') END AS dir FROM f",
    "raster_drivers": "SELECT * FROM (VALUES ('GTiff', 'tif'), ('GTiff', 'tiff'), ('HFA', 'img')) v(driver, extension)",
    "vector_drivers": "SELECT * FROM (VALUES ('ESRI Shapefile', 'shp'), ('SQLite', 'sqlite')) v(driver, extension)",
    "progress_round": f"{_PROGRESS} SELECT run, seq, round(round(status * 100, 9))::INTEGER AS percent FROM e WHERE status >= 0",
    "progress_ffill": f"{_PROGRESS} SELECT run, seq, coalesce(last_value(CASE WHEN status >= 0 THEN status END IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING), 0.0) AS status FROM e",
    "message_ffill": f"{_PROGRESS} SELECT run, seq, coalesce(last_value(nullif(message, '') IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING), '') AS message FROM e",
    "strip_prefix": "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN ' ' || c_name WHEN 1 THEN 'boost::alone' || c_name ELSE 'plain ' || c_name END AS text FROM customer",
    "filelist_add": f"{_FILES} SELECT DISTINCT path FROM f WHERE id % 2 = 0 OR id % 3 = 0",
    "filelist_remove": f"{_FILES} SELECT path FROM f WHERE path NOT IN (SELECT path FROM f WHERE id % 3 = 0)",
    "filelist_clear": f"{_FILES} SELECT path FROM f WHERE false",
    "filelist_read": f"{_FILES} SELECT path FROM f",
    "filelist_set": f"{_FILES} SELECT path FROM f WHERE id % 3 = 0",
    "file_filter": f"{_FILES} SELECT id, CASE WHEN regexp_matches(path, '\\.(tif|tiff|dat)$') THEN 'raster' WHEN regexp_matches(path, '\\.(sqlite|shp)$') THEN 'vector' ELSE 'other' END AS kind FROM f",
}
