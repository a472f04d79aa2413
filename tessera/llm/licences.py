"""Licence scans: TF-IDF cosine of notices and files to templates, then inheritance along directories.

A unit is a line of a text (a notice in a header) or a whole text (a licence file). Its vector has a component for
each different token: whether the unit has it (boolean term frequency, as notices are a sentence long), times its
inverse document frequency over all units, ln((1 + N) / (1 + df)). A line matches the template with the highest
cosine of at least `LINE`; a whole text of at least `FILE` is a licence file, whose licence covers its directory
and all below. A file without a notice of its own inherits from the nearest directory upwards that has one.

Everything is DataFrame and SQL functions. A first pass counts df of every token, summed inside each task before
the shuffle. A second pass keeps, inside the row, the units that can still match: with `cover` the mass that unit and
template share and `own` that of all template tokens in the unit, cosine <= cover / sqrt(own * template), so dropping
the others is exact. Only what is left (as many as there are notices, and near misses) meets the table of df, and its
tokens are joined with that by shuffle. Templates are a parameter; what is broadcast has their size. Directories are
resolved among themselves, then joined with the files.

A file is its id, path and text: rows that repeat all three count in df each and get the same result, and rows with
one id or path but other texts are files of their own. Null and empty texts have no notice but can inherit. Texts of
any length are taken whole. Equal cosines go to the smaller template name; several licence files of a directory: the
highest cosine, then the smaller licence name. A null path has no directory. Columns besides these three are left
out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

LINE, FILE = 0.6, 0.35
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices by which texts name their licence. (template, licence, text)
TEMPLATES = (
    ("agpl-3", "AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-3", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("cc-by", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0", "CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("gpl-2", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3", "LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "MIT", "Released under the MIT License."),
    ("mit-text", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("mpl-2", "MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, licence and its different tokens."""
    rows = " union all ".join("select '{}' as template, '{}' as licence, '{}' as text".format(*(x.replace("'", "''") for x in t)) for t in templates)
    return spark.sql(rows).select("template", "licence", _tokens("text").alias("tokens"))


def _tokens(column: str) -> Column:
    return F.expr(f"array_remove(array_distinct(split(translate({column}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+')), '')")


def _units() -> Column:
    """The different tokens of the whole text, then of each of its lines; the text is split once."""
    lines = f"transform(split(translate(text, '{UPPER}', '{LOWER}'), '\\n'), l -> array_remove(array_distinct(split(l, '[^a-z0-9]+')), ''))"
    return F.expr(f"transform(array({lines}), x -> concat(array(array_distinct(flatten(x))), x))[0]")


def scan(files: DataFrame, templates=TEMPLATES, line: float = LINE, whole: float = FILE) -> DataFrame:
    """files: file_id, path, text. Returns file_id, path, licence, cosine, is_file, inherited and from_dir.

    licence is the file's own or the inherited one, or null; cosine that of its own best unit, or null; from_dir
    the directory that it was inherited from.
    """
    known = template_table(files.sparkSession, templates).collect()  # a parameter's size
    vocabulary = sorted({t for r in known for t in r["tokens"]})
    word_list = F.array(*map(F.lit, vocabulary))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = files.select(F.col("file_id").alias("file_id"), F.col("path").cast("string").alias("path"), text.alias("text"))
    key = F.struct("file_id", "path", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c")).alias("key")

    # The empty token stands in every unit, so its df is the number of units.
    counted = named.select(F.explode(_units()).alias("tokens")).where("size(tokens) > 0").select(F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token"))
    dfs = materialise(counted.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "df")
    df = {r["token"]: r["df"] for r in dfs.where(F.col("token").isin(["", *vocabulary])).collect()}  # one for each template token
    n_units = df.pop("", 0)
    square = {t: _idf(n_units, df.get(t, 0)) ** 2 for t in vocabulary}
    squares = F.create_map(*(F.lit(x) for t in vocabulary for x in (t, square[t])))
    mass = {r["template"]: sum(square[t] for t in r["tokens"]) for r in known}
    summed = lambda tokens: F.aggregate(tokens, F.lit(0.0), lambda a, t: a + squares[t])

    units = named.select(key, F.posexplode(_units()).alias("unit", "tokens")).where("size(tokens) > 0")
    units = units.withColumn("common", F.array_intersect("tokens", word_list)).where("size(common) > 0")
    units = units.withColumn("own", summed("common")).withColumn("cut", F.when(F.col("unit") == 0, whole).otherwise(line))
    likely = units.where(F.col("own") >= F.col("cut") * F.col("cut") * min(mass.values()) * (1 - 1e-9))
    tried = F.array(*(F.struct(F.lit(r["template"]).alias("template"), F.lit(r["licence"]).alias("licence"), F.lit(mass[r["template"]]).alias("mass"), summed(F.array_intersect("common", F.array(*map(F.lit, r["tokens"])))).alias("cover")) for r in known))
    able = F.filter(tried, lambda t: t["cover"] >= F.col("cut") * F.sqrt(F.col("own") * t["mass"]) * (1 - 1e-9))
    likely = likely.withColumn("tried", able).where("size(tried) > 0").dropDuplicates(["key", "unit"])
    likely = materialise(likely.select("key", "unit", "own", "cut", "tried", F.array_except("tokens", word_list).alias("others")).withColumn("id", F.monotonically_increasing_id()), "likely")
    weight = F.log((1.0 + n_units) / (1.0 + F.col("df")))
    others = likely.select("id", F.explode("others").alias("token")).join(dfs, "token").groupBy("id").agg(F.sum(weight * weight).alias("rest"))
    massed = likely.join(others, "id", "left").withColumn("unit_mass", F.col("own") + F.coalesce("rest", F.lit(0.0)))
    cosines = massed.select("key", "unit", "cut", "unit_mass", F.explode("tried").alias("t"))
    cosines = cosines.withColumn("cosine", F.round(F.col("t.cover") / F.sqrt(F.col("unit_mass") * F.col("t.mass")), 6)).where("cosine >= cut")
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "t.template", "t.licence")).alias("best")
    own_best = cosines.groupBy("key").agg(best, F.max(F.col("unit") == 0).alias("is_file"))
    own_best = materialise(own_best.select("key", F.col("key.path").alias("path"), F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("cosine"), "is_file"), "own")

    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    covers = own_best.where("is_file and path is not null").select(directory.alias("dir"), "licence", "cosine").groupBy("dir")
    covers = covers.agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("best")).select(F.col("dir").alias("ancestor"), F.col("best.licence").alias("licence"))
    bare = named.select("file_id", "path", key).withColumn("dir", directory)
    dirs = bare.where("dir is not null").select("dir").distinct()
    parts = "split(dir, '/')"
    up = F.expr(f"transform(sequence(0, size({parts})), k -> struct(-k as depth, array_join(slice({parts}, 1, k), '/') as ancestor))")
    ancestors = dirs.select("dir", F.explode(up).alias("a")).select("dir", "a.*").distinct()
    nearest = ancestors.join(covers, "ancestor").groupBy("dir").agg(F.min(F.struct("depth", "ancestor", "licence")).alias("near"))
    nearest = materialise(nearest.select("dir", F.col("near.ancestor").alias("from_dir"), F.col("near.licence").alias("dir_licence")), "nearest")
    owned = own_best.select(F.col("key").alias("__key"), "licence", "cosine", "is_file")
    joined = bare.join(owned, F.col("key") == F.col("__key"), "left").join(nearest, "dir", "left")
    inherited = F.col("licence").isNull() & F.col("dir_licence").isNotNull()
    return joined.select(
        "file_id", "path", F.coalesce("licence", "dir_licence").alias("licence"), "cosine", F.coalesce("is_file", F.lit(False)).alias("is_file"), inherited.alias("inherited"), F.when(inherited, F.col("from_dir")).alias("from_dir")
    )


def _idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df))


#: Documents have no path of their own; this tree stands for one: some lie under their source, some under the
#: language there, the others in folders of a thousand ids below that. The same text is SQL in both engines.
PATH = (
    "concat(coalesce(source, 'none'), '/', case when doc_id % 50 = 0 then '' when doc_id % 10 = 0 then concat(coalesce(lang, 'none'), '/') "
    "else concat(coalesce(lang, 'none'), '/', cast(cast(floor(doc_id / 1000) as bigint) as varchar(20)), '/') end, cast(doc_id as varchar(20)))"
)


def oracle_sql(templates=TEMPLATES) -> str:
    """scan() over `documents` with PATH, in DuckDB SQL."""
    rows = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in templates)
    toks = lambda c: f"[x for x in list_distinct(regexp_split_to_array(translate({c}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+')) if x <> '']"
    return f"""
with templates as (select template, licence, {toks("text")} as tokens from (values {rows}) as t(template, licence, text)),
files as (select row_number() over () as rid, doc_id as file_id, {PATH} as path, coalesce(text, '') as text from documents),
pieces as (select rid, unnest(list_concat([text], string_split(text, chr(10)))) as text, generate_subscripts(list_concat([text], string_split(text, chr(10))), 1) - 1 as unit from files),
units as (select rid, unit, {toks("text")} as tokens from pieces where len({toks("text")}) > 0),
total as (select count(*) as n from units),
found as (select rid, unit, unnest(tokens) as token from units),
idf as (select token, ln((1 + n) / (1 + count(*))) as idf from found cross join total group by token, n),
masses as (select rid, unit, sum(idf * idf) as mass from found join idf using (token) group by rid, unit),
posting as (select template, licence, unnest(tokens) as token from templates),
weighed as (select template, licence, token, coalesce(idf, ln(1.0 + n)) as idf from posting left join idf using (token) cross join total),
template_mass as (select template, sum(idf * idf) as mass from weighed group by template),
cosines as (select f.rid, f.unit, w.template, w.licence, round(sum(w.idf * w.idf) / sqrt(max(m.mass) * max(t.mass)), 6) as cosine
  from found f join weighed w using (token) join masses m on m.rid = f.rid and m.unit = f.unit join template_mass t on t.template = w.template group by f.rid, f.unit, w.template, w.licence),
kept as (select *, row_number() over (partition by rid order by cosine desc, template) as r, max(case when unit = 0 then 1 else 0 end) over (partition by rid) = 1 as is_file
  from cosines where cosine >= case when unit = 0 then {FILE} else {LINE} end),
own as (select rid, path, licence, cosine, is_file from kept join files using (rid) where r = 1),
covers as (select dir as ancestor, licence from (select regexp_replace(path, '/[^/]*$', '') as dir, licence, row_number() over (partition by regexp_replace(path, '/[^/]*$', '') order by cosine desc, licence) as r from own where is_file) where r = 1),
dirs as (select distinct regexp_replace(path, '/[^/]*$', '') as dir from files),
near as (select dir, ancestor, licence, row_number() over (partition by dir order by length(ancestor) desc) as r from dirs join covers on dir = ancestor or starts_with(dir, ancestor || '/'))
select f.file_id as doc_id, f.path, coalesce(o.licence, n.licence) as licence, o.cosine, coalesce(o.is_file, false) as is_file, o.licence is null and n.licence is not null as inherited,
  case when o.licence is null and n.licence is not null then n.ancestor end as from_dir
from files f left join own o on o.rid = f.rid left join near n on n.dir = regexp_replace(f.path, '/[^/]*$', '') and n.r = 1"""
