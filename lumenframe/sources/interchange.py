"""XLIFF, TMX, TSV, CSV, TXT and UTX: units in and out, as DataFrames.

Writers build one document a file group from rows with asset, region_id, source, target, lang, reading_order and dnt.
Readers parse whole files (one row each) in Arrow batches, or lines natively. XML is read with entity expansion off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.text import xml_escape

#: Extension to format, fixed.
FORMATS = {"xliff": "xliff", "xlf": "xliff", "sdlxliff": "xliff", "mxliff": "xliff", "mqxliff": "xliff", "txlf": "xliff", "tmx": "tmx", "tsv": "tsv", "csv": "csv", "txt": "txt", "json": "json", "utx": "utx", "tbx": "tbx"}
UNITS = "path string, unit_id string, source string, target string, lang string, ordinal long"


def format_of(path) -> Column:
    """By extension; txt for unknown ones."""
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))), F.lit("txt"))


def asset_kind(path) -> Column:
    extension = F.lower(F.regexp_extract(F.regexp_replace(path, r"\?.*$", ""), r"\.([^.]+)$", 1))
    return F.when(extension.isin("mp4", "mov", "webm", "mkv", "avi"), "video").otherwise("image")


def exported(rows: DataFrame) -> DataFrame:
    """Rows that leave: those that may be translated and have a source."""
    return rows.where(~F.coalesce("dnt", F.lit(False)) & (F.trim("source") != ""))


def xliff_units(rows: DataFrame) -> DataFrame:
    """Each exported row's trans-unit."""
    state = F.when(F.trim(F.coalesce("target", F.lit(""))) == "", "needs-translation").otherwise("translated")
    unit = F.concat(
        F.lit('<trans-unit id="'), xml_escape(F.col("region_id")), F.lit('"><source>'), xml_escape("source"), F.lit('</source><target state="'), state, F.lit('">'),
        xml_escape(F.coalesce("target", F.lit(""))), F.lit("</target></trans-unit>"),
    )
    return exported(rows).withColumn("unit", unit)


def _ordered(rows: DataFrame, part: str) -> DataFrame:
    """The parts of an asset in reading order (nulls last, then id), joined by line breaks."""
    key = F.struct(F.col("reading_order").isNull().alias("n"), F.col("reading_order").alias("o"), F.col("region_id").alias("i"), F.col(part).alias("p"))
    return rows.groupBy("asset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["p"]), "\n").alias("body"), F.min("lang").alias("lang"))


def write_xliff(rows: DataFrame, source_lang: str = "en") -> DataFrame:
    """(asset, document): an XLIFF 1.2 file each."""
    head = F.concat(F.lit(f'<xliff version="1.2"><file source-language="{source_lang}" target-language="'), F.coalesce("lang", F.lit("")), F.lit('" original="'), xml_escape(F.col("asset").cast("string")), F.lit('"><body>\n'))
    return _ordered(xliff_units(rows), "unit").select("asset", F.concat(head, F.col("body"), F.lit("\n</body></file></xliff>")).alias("document"))


def write_tmx(rows: DataFrame, source_lang: str = "en") -> DataFrame:
    """(asset, document): pairs with both sides."""
    pairs = rows.where((F.trim("source") != "") & (F.trim("target") != ""))
    tuv = lambda lang, c: F.concat(F.lit('<tuv xml:lang="'), lang, F.lit('"><seg>'), xml_escape(c), F.lit("</seg></tuv>"))
    unit = F.concat(F.lit('<tu tuid="'), xml_escape(F.col("region_id")), F.lit('">'), tuv(F.lit(source_lang), "source"), tuv(F.coalesce("lang", F.lit("")), "target"), F.lit("</tu>"))
    body = _ordered(pairs.withColumn("unit", unit), "unit")
    return body.select("asset", F.concat(F.lit('<tmx version="1.4"><header/><body>\n'), F.col("body"), F.lit("\n</body></tmx>")).alias("document"))


def memory_pairs(plates: DataFrame, regions: DataFrame, profile: str = "semantic") -> DataFrame:
    """Rows for :func:`write_tmx`: of plates (``semantic``), of single regions (``atomic``) or of both; pairs with a blank side are left out.

    Plates have ``uid``, ``plate``, ``source``, ``target`` and ``lang``; regions ``region_id``, ``source``, ``target``, ``lang`` and ``dnt``.
    """
    if profile not in ("semantic", "atomic", "both"):
        raise ValueError(f"unknown profile {profile!r}")
    filled = lambda df, *both: df.where(F.expr(" AND ".join(f"trim(coalesce({c}, '')) <> ''" for c in both)))
    plate = filled(plates.select("asset", F.coalesce("uid", F.col("plate").cast("string")).alias("region_id"), "source", "target", "lang"), "source", "target")
    single = regions.where(~F.coalesce("dnt", F.lit(False))).select("asset", "region_id", F.trim("source").alias("source"), F.trim("target").alias("target"), "lang")
    parts = {"semantic": [plate], "atomic": [filled(single, "source", "target")]}
    chosen = parts.get(profile) or parts["semantic"] + parts["atomic"]
    return chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])


def write_txt(rows: DataFrame) -> DataFrame:
    return exported(rows).select("asset", F.concat(F.lit("["), F.col("region_id"), F.lit("] "), F.col("source")).alias("value"))


def read_txt(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines "[id] text"; others are dropped."""
    pattern = r"^\[([^\]]*)\](.*)$"
    return lines.where(F.col(value).rlike(pattern)).select(F.regexp_extract(value, pattern, 1).alias("unit_id"), F.trim(F.regexp_extract(value, pattern, 2)).alias("target"))


def read_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Rows (unit_id, target) of a file with a header; the column named target, else the third; blank ones are dropped."""
    df = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    target = next((c for c in df.columns if c.lower() == "target"), df.columns[min(2, len(df.columns) - 1)])
    rows = df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("unit_id"), F.col(f"`{target}`").alias("target"))
    return rows.where((F.col("unit_id") != "") & (F.trim("target") != ""))


def read_utx(lines: DataFrame, value: str = "value") -> DataFrame:
    """Glossary lines of at least four tab-separated columns; # begins a comment."""
    parts = F.split(value, "\t")
    return lines.where(~F.col(value).startswith("#") & (F.size(parts) >= 4)).select(F.trim(parts[0]).alias("source"), F.trim(parts[1]).alias("target")).where("source <> '' AND target <> ''")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parse(text: str):
    from xml.etree import ElementTree

    if "<!ENTITY" in text or re.search(r"<!DOCTYPE[^>\[]*\[", text):
        raise ValueError("documents with entities or an internal subset are refused")
    return ElementTree.fromstring(text)


def xliff_rows(text: str) -> list[tuple[str, str, str, str | None]]:
    """(id, source, target, language) of 1.2 trans-units and of the segments of 2.x units; inline markup gives its text."""
    root, out, lang2 = _parse(text), [], None
    for file in (e for e in root.iter() if _local(e.tag) in ("file", "xliff")):
        if _local(file.tag) == "xliff":
            lang2 = file.get("trgLang")
            continue
        lang = file.get("target-language") or file.get("trgLang") or lang2
        for unit in (e for e in file.iter() if _local(e.tag) in ("trans-unit", "unit")):
            segments = [e for e in unit.iter() if _local(e.tag) == "segment"] or [unit]
            for s in segments:
                part = {_local(e.tag): "".join(e.itertext()) for e in s if _local(e.tag) in ("source", "target")}
                out.append((unit.get("id", ""), part.get("source", ""), part.get("target", ""), lang))
    return out


def tmx_rows(text: str) -> list[tuple[str, str, str, str | None]]:
    """(id, first segment, last segment, its language) of units with at least two variants."""
    out = []
    for tu in (e for e in _parse(text).iter() if _local(e.tag) == "tu"):
        tuvs = [e for e in tu if _local(e.tag) == "tuv"]
        if len(tuvs) >= 2:
            seg = ["".join(next((s for s in t if _local(s.tag) == "seg"), t).itertext()) for t in (tuvs[0], tuvs[-1])]
            lang = next((v for k, v in tuvs[-1].attrib.items() if _local(k) == "lang"), None)
            out.append((tu.get("tuid", ""), seg[0], seg[1], lang))
    return out


def tbx_rows(text: str) -> list[tuple[str, str, str, str | None]]:
    """The terms of each entry's first two languages."""
    out = []
    for entry in (e for e in _parse(text).iter() if _local(e.tag) in ("termEntry", "conceptEntry")):
        sets = [e for e in entry if _local(e.tag) in ("langSet", "langSec")][:2]
        terms = [next(("".join(t.itertext()) for t in s.iter() if _local(t.tag) == "term"), "") for s in sets]
        if len(terms) == 2 and all(x.strip() for x in terms):
            out.append((entry.get("id", ""), terms[0], terms[1], next((v for k, v in sets[1].attrib.items() if _local(k) == "lang"), None)))
    return out


READERS = {"xliff": xliff_rows, "tmx": tmx_rows, "tbx": tbx_rows}


def read_documents(documents: DataFrame, kind: str, path: str = "path", content: str = "document") -> DataFrame:
    """Units of whole documents; one that can't be parsed fails the read with its path."""
    reader = READERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, text in zip(pdf[path], pdf[content]):
                try:
                    rows += [(str(name), *u, i) for i, u in enumerate(reader(text))]
                except Exception as e:
                    raise ValueError(f"{kind} in {name}: {e}") from e
            yield pd.DataFrame(rows, columns=["path", "unit_id", "source", "target", "lang", "ordinal"])

    return documents.select(path, content).mapInPandas(run, UNITS)


def target_map(units: DataFrame) -> DataFrame:
    """The last non-empty target of each id in a document."""
    from lumenframe.operators.store import newest_per_key

    return newest_per_key(units.where(F.trim("target") != ""), ["path", "unit_id"], 1, F.desc("ordinal")).select("path", "unit_id", "target")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, document): whole files, decoded by their byte order mark, else as UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 4))
    text = (
        F.when(head.startswith("FFFE0000") | (head == "0000FEFF"), F.decode("content", "UTF-32")).when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode("content", "UTF-16")).otherwise(F.decode("content", "UTF-8"))
    )
    return files.select("path", F.regexp_replace(text, "^﻿", "").alias("document"))


def manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON manifests, one file each; absent keys are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def merge_server_owned(stored: Column, sent: Column, keys: list[str]) -> Column:
    """A payload's own value of each key where the key is present (even if empty), else the stored one; both are JSON objects."""
    has = F.from_json(sent, "map<string,string>")
    old = F.from_json(stored, "map<string,string>")
    owned = F.map_filter(old, lambda k, v: k.isin(keys) & ~F.map_contains_key(has, k))
    return F.map_concat(has, owned)


#: Columns of delimited exports, fixed.
TABULAR = ("id", "source", "src_lang", "target", "tgt_lang", "font", "bbox")


def tabular_rows(regions: DataFrame) -> DataFrame:
    """The asset and the seven columns of each region that may be translated; languages fall back to the detected and the asset's own."""
    text = lambda *names: F.coalesce(*[F.col(n) for n in names if n in regions.columns], F.lit(""))
    box = F.concat_ws(",", *[F.col(k).cast("string") for k in "xywh"])
    rows = regions.where(~F.coalesce("dnt", F.lit(False)))
    return rows.select(
        "asset", F.col("region_id").alias("id"), text("source").alias("source"), text("language", "detected_language", "src_lang").alias("src_lang"), text("target").alias("target"),
        text("target_language", "targ_lang").alias("tgt_lang"), text("font").alias("font"), box.alias("bbox"), "reading_order",
    )


def write_delimited(regions: DataFrame, sep: str = ",") -> DataFrame:
    """(asset, document): a CSV file each with quotes where a cell needs them, or with a tab a TSV file without any."""
    quote = lambda c: F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c)) if sep == "," else F.col(c)
    end = "\r\n" if sep == "," else "\n"
    rows = tabular_rows(regions).withColumn("line", F.concat_ws(sep, *map(quote, TABULAR))).withColumnRenamed("id", "region_id").withColumn("lang", F.lit(None).cast("string"))
    key = F.struct(F.col("reading_order").isNull().alias("n"), F.col("reading_order").alias("o"), F.col("region_id").alias("i"), F.col("line").alias("p"))
    lines = rows.groupBy("asset").agg(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["p"]).alias("lines"))  # an asset's own file
    body = F.array_join(F.concat(F.array(F.lit(sep.join(TABULAR))), "lines"), end)
    return lines.select("asset", F.concat(body, F.lit(end)).alias("document") if sep == "," else body.alias("document"))


def write_tables(regions: DataFrame, path: str, sep: str = "\t") -> None:
    """All assets' rows as delimited files with a header, written where they lie."""
    tabular_rows(regions).select("asset", *TABULAR).write.option("sep", sep).option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def delimited_units(text: str, sep: str) -> list[tuple[str, str, str, str | None]]:
    """(id, source, target, language): by a column named target, else the third."""
    import csv
    import io

    rows = csv.reader(io.StringIO(text), delimiter=sep)
    head = [h.strip().lower() for h in next(rows, [])]
    if not head:
        return []
    at = head.index("target") if "target" in head else 2
    of = {k: head.index(k) for k in ("source", "tgt_lang") if k in head}
    cell = lambda r, k: r[of[k]] if k in of and len(r) > of[k] else None
    return [(r[0], cell(r, "source") or "", r[at], cell(r, "tgt_lang")) for r in rows if len(r) > at]


def txt_units(text: str) -> list[tuple[str, str, str, str | None]]:
    found = (re.match(r"\[([^\]]*)\](.*)$", line) for line in text.splitlines())
    return [(m[1], "", m[2].strip(), None) for m in found if m]


READERS |= {"csv": lambda t: delimited_units(t, ","), "tsv": lambda t: delimited_units(t, "\t"), "txt": txt_units}


def import_files(files: DataFrame, path: str = "path", content: str = "document") -> DataFrame:
    """Units of files of any known format, each read by the reader of its extension; those that can't be read come with ``error``."""
    marked = files.select(F.col(path).alias("path"), F.col(content).alias("document"), format_of(F.col(path)).alias("format"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, text, kind in zip(pdf["path"], pdf["document"], pdf["format"]):
                try:
                    rows += [(name, kind, *u, i, None) for i, u in enumerate(READERS.get(kind, txt_units)(text or ""))]
                except Exception as e:
                    rows.append((name, kind, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "format", "unit_id", "source", "target", "lang", "ordinal", "error"]).astype({"ordinal": "Int64"})

    return marked.mapInPandas(run, "path string, format string, unit_id string, source string, target string, lang string, ordinal long, error string")


def is_semantic(document: Column, sep: str = ",") -> Column:
    """Whether a delimited file names plates in its header."""
    head = F.split(F.regexp_replace(F.substring_index(document, "\n", 1), '[\r"]', ""), re.escape(sep))
    return F.array_contains(F.transform(head, lambda h: F.trim(h)), "plate_uid")


def readiness(plates: DataFrame, returned: DataFrame, *, key: str = "asset") -> DataFrame:
    """Returned plates (key, uid, revision, target): accepted, stale (the plate has changed since, so that it is refused), unknown or blank."""
    now = plates.select(key, "uid", F.col("revision").alias("__now"))
    state = F.when(F.col("__now").isNull(), "unknown").when(F.col("__now") != F.col("revision"), "stale").when(F.trim(F.coalesce("target", F.lit(""))) == "", "blank").otherwise("accepted")
    return returned.join(now, [key, "uid"], "left").select(key, "uid", "target", state.alias("state"))


def _glossary_column(names: list[str], *aliases: str) -> str | None:
    plain = lambda n: re.sub(r"[\s_-]", "", n).lower()
    wanted = {plain(a) for a in aliases}
    return next((n for n in names if plain(n) in wanted), None)


def glossary_entries(rows: DataFrame, src: str | None = None, targ: str | None = None) -> DataFrame:
    """(source, target, src_lang, targ_lang) of a table whose columns go by any of the usual names; without any of them the first two are meant.

    Languages come from columns, else from ``src`` and ``targ``; rows that lack a term or a language are left out.
    """
    from lumenframe.functions.text import clean_cell, locale_tag

    names = rows.columns
    source = _glossary_column(names, "source", "src", "source_term", "term")
    target = _glossary_column(names, "target", "targ", "translation", "target_term")
    own = lambda n: F.col("`" + n.replace("`", "``") + "`")
    if source is None:
        source, target = names[0], names[1]
    target = target or names[1]
    lang = lambda found, given: locale_tag(own(found)) if found else locale_tag(F.lit(given or ""))
    out = rows.select(
        clean_cell(own(source)).alias("source"), clean_cell(own(target)).alias("target"),
        lang(_glossary_column(names, "src_lang", "source_language", "source_locale"), src).alias("src_lang"), lang(_glossary_column(names, "targ_lang", "target_language", "target_locale"), targ).alias("targ_lang"),
    )
    return out.where("source <> '' AND target <> '' AND src_lang <> '' AND targ_lang <> ''")


#: What a correction resource has to state, fixed.
RESOURCE_FIELDS = ("id", "kind", "locale", "schema_version", "data_version", "checksum", "provenance", "license", "entries")


def correction_resources(files: DataFrame, schema_version: int = 1, path: str = "path", content: str = "document") -> DataFrame:
    """(path, id, kind, locale, data_version, entry, error): a row for each entry of a sound resource, or one with what is wrong with it."""
    import json

    def fault(data) -> str | None:
        if not isinstance(data, dict):
            return "not an object"
        if lost := sorted(set(RESOURCE_FIELDS) - data.keys()):
            return f"missing fields: {', '.join(lost)}"
        if data["schema_version"] != schema_version:
            return "unsupported schema_version"
        if not re.fullmatch(r"\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?", str(data["data_version"])):
            return "data_version is no semantic version"
        if not isinstance(data["entries"], list) or not all(isinstance(e, dict) for e in data["entries"]):
            return "entries are no list of objects"
        if not isinstance(data["provenance"], dict):
            return "provenance is no object"
        return None if data["checksum"] == checksum(data["entries"]) else "checksum mismatch"

    def checksum(entries) -> str:
        import hashlib

        return "sha256:" + hashlib.sha256(json.dumps(entries, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, text in zip(pdf[path], pdf[content]):
                try:
                    data = json.loads(text)
                    wrong = fault(data)
                except ValueError as e:
                    data, wrong = None, str(e)
                if wrong:
                    rows.append((name, None, None, None, None, None, wrong))
                else:
                    head = (name, str(data["id"]), str(data["kind"]), str(data["locale"]), data["data_version"])
                    rows += [(*head, json.dumps(e, ensure_ascii=False, sort_keys=True), None) for e in data["entries"]]
            yield pd.DataFrame(rows, columns=["path", "id", "kind", "locale", "data_version", "entry", "error"])

    return files.select(path, content).mapInPandas(run, "path string, id string, kind string, locale string, data_version string, entry string, error string")


#: A manifest's shape; keys that a file lacks are null.
BOX = "struct<x:int,y:int,width:int,height:int>"
MANIFEST = (
    "asset_id string, total_regions int, src_lang string, targ_lang string, img_dim array<int>, "
    f"instances array<struct<id:string,bounding_box:{BOX},text:string,target_text:string,language:string,detected_language:string,confidence:double,reading_order:int,dnt:boolean,excluded:boolean,target_language:string>>, "
    f"semantic_units array<struct<id:string,plate_uid:string,region_ids:array<string>,source_text:string,bbox:{BOX},origin:string,membership_hash:string,review_required:boolean>>, "
    f"scene_regions array<struct<bbox:{BOX},semantic_label:string,confidence:double>>"
)


def manifest_problems(manifests_: DataFrame) -> Column:
    """What is wrong with a manifest's ids: live ones have to be r1 to rN, all ids different, and every reference has to name one."""
    all_ids = F.transform("instances", lambda i: i["id"])
    live = F.transform(F.filter("instances", lambda i: ~F.coalesce(i["excluded"], F.lit(False))), lambda i: i["id"])
    wanted = F.transform(F.sequence(F.lit(1), F.greatest(F.size(live), F.lit(1))), lambda n: F.concat(F.lit("r"), n.cast("string")))
    named = F.flatten(F.transform(F.coalesce("semantic_units", F.array().cast(manifests_.schema["semantic_units"].dataType)), lambda u: F.coalesce(u["region_ids"], F.array().cast("array<string>"))))
    rules = {
        "not_contiguous": (F.size(live) > 0) & ((F.size(F.array_distinct(live)) != F.size(live)) | (F.size(F.array_except(wanted, live)) > 0)),
        "duplicate_id": F.size(F.array_distinct(all_ids)) != F.size(all_ids), "dangling_reference": F.size(F.array_except(named, all_ids)) > 0,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(code)) for code, on in rules.items()]))


def save_manifests(manifests_: DataFrame, path: str, *, guard: bool = True) -> None:
    """Write manifests as JSON lines by asset; with the guard, one whose ids are not sound fails the write. Null fields stay."""
    checked = manifests_
    if guard:
        wrong = manifest_problems(manifests_)
        sound = F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("manifest of "), F.col("asset_id"), F.lit(": "), F.array_join(wrong, ", "))).cast("string")).otherwise(F.col("asset_id"))
        checked = manifests_.withColumn("asset_id", sound)
    checked.write.option("ignoreNullFields", False).json(path)


def load_manifests(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Manifests from JSON lines."""
    return spark.read.schema(schema).json(path)


def manifest_of(regions: DataFrame, *, key: str = "asset") -> DataFrame:
    """A manifest of each asset from its regions, in reading order."""
    instance = F.struct(
        F.col("reading_order").cast("int").alias("__o"), F.col("region_id").alias("id"), F.struct(*[F.col(k).cast("int").alias(n) for k, n in zip("xywh", ("x", "y", "width", "height"))]).alias("bounding_box"),
        F.col("source").alias("text"), F.col("target").alias("target_text"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("detected_language"), F.col("conf").cast("double").alias("confidence"),
        F.col("reading_order").cast("int").alias("reading_order"), F.coalesce("dnt", F.lit(False)).alias("dnt"), F.lit(False).alias("excluded"), F.lit(None).cast("string").alias("target_language"),
    )
    made = regions.groupBy(F.col(key).cast("string").alias("asset_id")).agg(F.array_sort(F.collect_list(instance)).alias("instances"))
    none = lambda name: F.lit(None).cast(next(t for n, t in (f.split(" ", 1) for f in MANIFEST.split(", ")) if n == name))
    own = F.transform("instances", lambda i: i.dropFields("__o"))
    return made.select("asset_id", F.size("instances").alias("total_regions"), none("src_lang").alias("src_lang"), none("targ_lang").alias("targ_lang"), none("img_dim").alias("img_dim"), own.alias("instances"), none("semantic_units").alias("semantic_units"), none("scene_regions").alias("scene_regions"))
