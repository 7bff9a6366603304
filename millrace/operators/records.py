"""Reads over stored records, history, drafts and jobs, and changes that are joins over other records.

Records have (id, module, title, payload, archived, updated_at); a payload is JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import company_name, text

#: The default and the bounds of the number of history entries that are kept.
HISTORY_DEFAULT, HISTORY_LEAST, HISTORY_MOST = 100, 10, 1_000


def list_records(records: DataFrame, module: str, archived: bool = False) -> DataFrame:
    """Records of a module, the last changed first; archived ones only if asked for."""
    own = records.where(F.col("module") == module)
    return (own if archived else own.where(~F.coalesce("archived", F.lit(False)))).orderBy(F.desc("updated_at"), "id")


def lookup(rows: DataFrame, **keys) -> DataFrame:
    """The row with these key values, archived or not: a record by module and id, a draft by module and key."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == value)
    return rows.limit(1)


def newest(rows: DataFrame, by: list[str], most: int, **keys) -> DataFrame:
    """The newest rows of one owner: history and events by id (100), jobs by creation (200)."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(*[F.desc(c) for c in by]).limit(most)


def prioritised(rows: DataFrame, first: Column, by: str) -> DataFrame:
    """The one row that comes first: those for which `first` holds before others, then the newest."""
    return rows.orderBy(F.desc(F.coalesce(first, F.lit(False))), F.desc(by)).limit(1)


def history_limit(records: DataFrame) -> DataFrame:
    """(history_limit): the setting of the record titled `application` that was changed last, within its bounds."""
    own = records.where("title = 'application' AND NOT coalesce(archived, false)")
    setting = own.agg(F.max_by("payload", "updated_at").alias("payload"))
    value = F.coalesce(F.get_json_object("payload", "$.historyLimit").try_cast("long"), F.lit(HISTORY_DEFAULT))
    return setting.select(F.greatest(F.lit(HISTORY_LEAST), F.least(F.lit(HISTORY_MOST), value)).alias("history_limit"))


def registry_archive(records: DataFrame, chosen: DataFrame | None, attachments: DataFrame, paths: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Records that aren't archived, of the ids chosen if there are any, by title; and the distinct attachment paths
    (id, path) of theirs, of the paths chosen if there are any."""
    kept = records.where(~F.coalesce("archived", F.lit(False)))
    if chosen is not None:
        kept = kept.join(chosen.select("id"), "id", "left_semi")
    files = attachments.join(kept.select("id"), "id", "left_semi").select("path").where("trim(coalesce(path, '')) <> ''").distinct()
    if paths is not None:
        files = files.join(paths.select("path"), "path", "left_semi")
    return kept.orderBy("title", "id"), files


def snapshots(links: DataFrame, records: DataFrame, captured: Column) -> DataFrame:
    """links (source_id, ...) with a copy of the source's payload as it is now: (id, title, payload, captured_at)."""
    copy = F.struct(F.col("id"), F.col("title"), F.col("payload"), captured.alias("captured_at")).alias("snapshot")
    return links.join(records.select(F.col("id").alias("source_id"), copy), "source_id")


def gap_checklist(requirements: DataFrame, checklist: DataFrame, key: str, settled: list[str]) -> DataFrame:
    """(key, text, responsible, due): entries to add for mandatory requirements whose status isn't settled and whose
    text the checklist of the same owner doesn't hold."""
    open_ = requirements.where(F.col("mandatory") & ~text(F.col("status")).isin(settled)).select(key, "text", "responsible", "due")
    return open_.join(checklist.select(key, "text"), [key, "text"], "left_anti")


def renamed_company(contracts: DataFrame, renames: DataFrame) -> DataFrame:
    """Contracts (performer, performer_id, customer, customer_id, ...) with the new name and id of companies that
    `renames` (id, old_name, new_name) lists, found by id or by the old name's normal form. An id wins over a name;
    an old name should be listed once. `changed` tells which rows differ."""
    by_id = renames.select(F.col("id").alias("_id"), F.col("new_name").alias("_by_id"))
    by_name = renames.select(company_name(F.col("old_name")).alias("_name"), F.col("id").alias("_named_id"), F.col("new_name").alias("_by_name")).where("_name <> ''")
    out, hit = contracts, []
    for side in ("performer", "customer"):
        out = out.join(by_id, F.col(f"{side}_id") == F.col("_id"), "left").join(by_name, company_name(F.col(side)) == F.col("_name"), "left")
        found = F.col("_by_id").isNotNull() | F.col("_by_name").isNotNull()
        out = out.withColumns({side: F.coalesce("_by_id", "_by_name", side), f"{side}_id": F.when(F.col("_by_id").isNotNull(), F.col("_id")).otherwise(F.coalesce("_named_id", f"{side}_id")), f"_hit_{side}": found})
        out, hit = out.drop("_id", "_by_id", "_name", "_named_id", "_by_name"), [*hit, F.col(f"_hit_{side}")]
    return out.withColumn("changed", hit[0] | hit[1]).drop("_hit_performer", "_hit_customer")


def affiliation_labels(companies: DataFrame) -> DataFrame:
    """(id, labels) of companies (id, name, affiliations (type, target, note)): `type: name — note` of each, in their
    order; targets that don't exist are left out."""
    each = companies.select("id", F.posexplode("affiliations").alias("at", "a"))
    names = companies.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    label = F.concat(F.col("a.type"), F.lit(": "), F.col("target_name"), F.when(F.trim(text(F.col("a.note"))) != "", F.concat(F.lit(" — "), F.trim("a.note"))).otherwise(""))
    found = each.join(names, F.col("a.target") == F.col("target")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", label.alias("label")))).alias("labels"))
    return companies.select("id").join(found, "id", "left").select("id", F.coalesce(F.transform("labels", lambda x: x["label"]), F.array().cast("array<string>")).alias("labels"))


def repeated_people(people: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """people (row, name, birth) with `repeated`, for an earlier row of the same name (blanks and case apart) and birth
    date, and `registered`, for one in `known` (case apart)."""
    key = F.concat_ws("\0", F.lower(F.trim(text(F.col("name")))), text(F.col("birth").cast("string")))
    first = people.groupBy(key.alias("_key")).agg(F.min("row").alias("_first"))
    out = people.withColumn("_key", key).join(first, "_key").withColumn("repeated", F.col("row") > F.col("_first"))
    if known is not None:
        own = lambda: F.concat_ws("\0", F.lower(text(F.col("name"))), text(F.col("birth").cast("string")))
        there = known.select(own().alias("_known")).distinct()
        out = out.withColumn("_own", own()).join(there, F.col("_own") == F.col("_known"), "left").withColumn("registered", F.col("_known").isNotNull()).drop("_own", "_known")
    return out.drop("_key", "_first")


def document_paths(people: DataFrame, chosen: DataFrame, categories: list[str]) -> DataFrame:
    """(id, path) of the documents (category, path) of chosen people, in the categories, with a path."""
    own = people.join(chosen.select("id"), "id", "left_semi").select("id", F.explode("documents").alias("d"))
    return own.where(F.col("d.category").isin(categories) & (F.trim(text(F.col("d.path"))) != "")).select("id", "d.path")


def primary_assignment(assignments: str, legacy: Column) -> Column:
    """The first assignment that is primary, else the first; people without any have one made of their own fields."""
    entries = F.coalesce(assignments, F.array())
    chosen = F.filter(entries, lambda a: F.coalesce(a["is_primary"], F.lit(False)))
    return F.when(F.size(chosen) > 0, F.get(chosen, F.lit(0))).when(F.size(entries) > 0, F.get(entries, F.lit(0))).otherwise(legacy)


def rotation(files: DataFrame, pinned: DataFrame, keep: int, cutoff: Column) -> DataFrame:
    """The files (name, modified) to remove: beyond the `keep` newest of those not pinned, or older than the cutoff."""
    free = files.join(pinned.select("name"), "name", "left_anti")
    newest_kept = free.orderBy(F.desc("modified"), F.desc("name")).limit(keep)
    # what stays is few rows; all others are found by an anti join, not by a rank over all of them
    return free.join(newest_kept.where(F.col("modified") >= cutoff).select("name"), "name", "left_anti")


def new_versions(versions: DataFrame, added: DataFrame) -> DataFrame:
    """Versions to add (document, version, sha256, supersedes, ...): those whose content the document has already
    are refused (left out); the others supersede the document's last version unless they say otherwise.
    versions: (document, version, sha256, place)."""
    fresh = added.join(versions.select("document", "sha256"), ["document", "sha256"], "left_anti")
    last = versions.groupBy("document").agg(F.max_by("version", "place").alias("_last"))
    return fresh.join(last, "document", "left").withColumn("supersedes", F.coalesce(F.nullif("supersedes", F.lit("")), "_last")).drop("_last")
