"""Merging, renaming and deleting persons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lumigraph.functions import names
from lumigraph.operators.components import components
from lumigraph.session import cut, drop_cut, keep_cut, ship


def with_actions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with their decision; Skip where there is none."""
    return candidates.join(decisions, ["id1", "id2"], "left").withColumn("action", F.coalesce("action", F.lit("Skip")))


def remaining(candidates: DataFrame, processed: DataFrame) -> DataFrame:
    return candidates.join(processed, ["id1", "id2"], "left_anti")


def existing(candidates: DataFrame, persons: DataFrame) -> DataFrame:
    """Candidates both of whose persons exist."""
    ids = persons.select("cluster_id").distinct()
    return candidates.join(ids.withColumnRenamed("cluster_id", "id1"), "id1", "left_semi").join(ids.withColumnRenamed("cluster_id", "id2"), "id2", "left_semi")


def fold(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """Merges in order: each takes id2 away, unless either id already was taken."""
    gone: set[int] = set()
    out = []
    for seq, a, b in sorted(rows):
        void = a in gone or b in gone
        if not void:
            gone.add(b)
        out.append((seq, a, b, "void" if void else "merged"))
    return out


def apply_decisions(decisions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``(seq, id1, id2, outcome)`` of ``(seq, id1, id2, action)``, as if done in the order of (seq, id1, id2).

    Merge takes id2 away into id1 (merged), but only if both have files in ``files`` (else the pair is done with:
    empty); Reject drops the pair (rejected), Skip leaves it open; a pair of which an id was taken away before is void.
    The order only matters among merges that share ids, so each connected set of merges is folded on its own, and the
    other pairs are judged by when their ids went.
    """
    ship(decisions.sparkSession)
    rows = decisions.where("id1 is not null and id2 is not null and id1 <> id2").withColumn("action", F.when(F.col("action").isin("Merge", "Reject"), F.col("action")).otherwise("Skip"))
    if files is not None:
        held = files.where("cluster_id is not null").select("cluster_id").distinct().withColumn("held", F.lit(True))
        for c in ("id1", "id2"):
            rows = rows.join(held.select(F.col("cluster_id").alias(c), F.col("held").alias("_" + c)), c, "left")
        rows = rows.withColumn("action", F.when((F.col("action") == "Merge") & (F.col("_id1").isNull() | F.col("_id2").isNull()), "Empty").otherwise(F.col("action")))
    rows = cut(rows.select("seq", "id1", "id2", "action").distinct())
    merges = rows.where("action = 'Merge'").select("seq", "id1", "id2")
    linked = components(merges.select(F.col("id1").cast("long").alias("u"), F.col("id2").cast("long").alias("v")))
    placed = merges.join(linked.select(F.col("id").cast("int").alias("id1"), "root"), "id1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(list(zip(pdf.seq, pdf.id1, pdf.id2))), columns=["seq", "id1", "id2", "outcome"])

    done = cut(placed.select("root", "seq", "id1", "id2").groupBy("root").applyInPandas(run, "seq long, id1 int, id2 int, outcome string"))
    went = done.where("outcome = 'merged'").select(F.col("id2").alias("gone"), F.struct("seq", "id1", "id2").alias("at"))
    rest = rows.where("action <> 'Merge'").withColumn("now", F.struct("seq", "id1", "id2"))
    for c in ("id1", "id2"):
        rest = rest.join(went.select(F.col("gone").alias(c), F.col("at").alias("at_" + c)), c, "left")
    void = F.coalesce(F.col("at_id1") < F.col("now"), F.lit(False)) | F.coalesce(F.col("at_id2") < F.col("now"), F.lit(False))
    name = F.when(F.col("action") == "Reject", "rejected").when(F.col("action") == "Empty", "empty").otherwise("open")
    return done.unionByName(rest.select("seq", "id1", "id2", F.when(void, "void").otherwise(name).alias("outcome")))


def survivors(outcome: DataFrame) -> DataFrame:
    """``(gone, into)``: of every id taken away the one that its files end up with, by pointer doubling."""
    step = cut(outcome.where("outcome = 'merged'").select(F.col("id2").alias("gone"), F.col("id1").alias("into")))
    while True:
        up = step.select(F.col("gone").alias("into"), F.col("into").alias("next"))
        nxt = cut(step.join(up, "into", "left").select("gone", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("moved")))
        drop_cut(step)
        if not nxt.where("moved").limit(1).count():
            return nxt.select("gone", "into")
        step = keep_cut(nxt.select("gone", "into"), nxt)


def merged_files(files: DataFrame, outcome: DataFrame) -> DataFrame:
    """Distinct ``(cluster_id, media_path)`` after merging: all files of an id taken away are the survivor's."""
    into = survivors(outcome)
    return files.join(into, files.cluster_id == into.gone, "left").select(F.coalesce("into", "cluster_id").alias("cluster_id"), "media_path").distinct()


def unique_names(people: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``(cluster_id, name)``: sanitised names made unique as name, name_1, name_2 ..., in the order of cluster_id.

    Names compete only if one is the other with numbers appended, so each family is folded on its own; ``taken`` holds
    names that exist already.  Blank names are left out.
    """
    ship(people.sparkSession)
    clean = people.select("cluster_id", names.sanitise(F.col("name")).alias("name")).where("name is not null")
    family = F.regexp_replace("name", r"(_[0-9]+)+$", "")
    rows = clean.withColumn("family", family).withColumn("own", F.lit(True))
    if taken is not None:
        rows = rows.unionByName(taken.select(F.lit(None).cast("int").alias("cluster_id"), "name", family.alias("family"), F.lit(False).alias("own")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, last, out = set(pdf.name[~pdf.own]), {}, []
        for r in pdf[pdf.own].sort_values("cluster_id").itertuples():
            name, k = r.name, last.get(r.name, 0)
            while name in used:
                k += 1
                name = f"{r.name}_{k}"
            last[r.name] = k
            used.add(name)
            out.append((r.cluster_id, name))
        return pd.DataFrame(out, columns=["cluster_id", "name"])

    return rows.groupBy("family").applyInPandas(run, "cluster_id int, name string")


def rename_and_delete(persons: DataFrame, edits: DataFrame) -> DataFrame:
    """``(cluster_id, name, old_name)`` after the edits ``(cluster_id, new_name, remove)``: renames first, then deletions.

    A blank or unchanged new name changes nothing; a taken one gets the first free number, where the names of all
    persons count as taken, those that are deleted afterwards too.
    """
    new = names.sanitise(F.col("new_name"))
    rows = persons.join(edits, "cluster_id", "left").select("cluster_id", F.col("name").alias("old_name"), F.when(new != F.col("name"), new).alias("new"), F.coalesce("remove", F.lit(False)).alias("remove"))
    made = unique_names(rows.where("new is not null").select("cluster_id", F.col("new").alias("name")), persons.select("name"))
    out = rows.join(made, "cluster_id", "left").where("not remove")
    return out.select("cluster_id", F.coalesce("name", "old_name").alias("name"), "old_name")


def renamed_paths(paths: DataFrame, renamed: DataFrame, root: str = "output") -> DataFrame:
    """``(cluster_id, path)``: paths below a person's folder, in the folder of the person's new name."""
    old = F.concat(F.lit(root + "/"), F.col("old_name"), F.lit("/"))
    at = paths.join(renamed, "cluster_id")
    new = F.concat(F.lit(root + "/"), F.col("name"), F.lit("/"), F.substring(F.col("path"), F.length(old) + 1, F.length("path")))
    return at.select("cluster_id", F.when(F.startswith(F.col("path"), old), new).otherwise(F.col("path")).alias("path"))


def ranked(df: DataFrame, group: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with 1-based numbers within groups (``n``) however large: ranks in ranges of (group, order), added up.

    Rows must differ in ``order``; a range holds several groups or a part of one, so no group meets in one task.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, group, *order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(group, "_p").agg(F.count("*").alias("_c")).select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_b"))  # a row a group and range
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_p", group).orderBy(*order)))
    return own.join(before, own[group].eqNullSafe(F.col("_g")) & (own["_p"] == F.col("_q"))).withColumn("n", F.col("_b") + F.col("_r")).drop("_p", "_q", "_g", "_b", "_r")


def row_numbers(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """1-based numbers within small groups (``n``)."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
