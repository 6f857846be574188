"""Trees as flat tables of files (path, id, exec): directories, overlays, listings, look-ups."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, depth, name_of, parent
from .graph import kept

FILE = ["path", "id", "exec"]


def entries(files: DataFrame, *by: str) -> DataFrame:
    """All entries (`by`, path, kind, id, exec), directories and the root "" among them; a tree for each value of the columns `by`.

    A directory's id is the hash of how many entries it has and of the sums of
    their hashes, in four words each, so it is built by partial sums wherever its
    entries lie, however many there are. Equal subtrees have equal ids, and unequal
    ones unequal ids, unless someone seeks such sums on purpose. Levels are hashed
    from the deepest up; a level is one aggregate by parent.
    """
    each = kept(files.select(*by, *FILE, F.lit("blob").alias("kind"), depth(F.col("path")).alias("depth")))
    deepest = each.agg(F.max("depth")).first()[0] or 0
    line = F.concat(F.length("name"), F.lit(":"), F.col("name"), F.lit("|"), F.col("kind"), F.lit("|"), F.col("id"), F.lit("|"), F.col("exec").cast("int"))
    word = lambda i: F.conv(F.substring("hash", 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(word(i)).cast("string") for i in range(4)]
    out, dirs = each.select(*by, "path", "kind", "id", "exec"), None
    for d in range(deepest, 0, -1):
        level = each.filter(F.col("depth") == d).select(*by, "path", "kind", "id", "exec")
        level = level if dirs is None else level.unionByName(dirs)
        hashed = level.select(*by, parent(F.col("path")).alias("path"), name_of(F.col("path")).alias("name"), "kind", "id", "exec").withColumn("hash", F.sha2(line, 256))
        ids = hashed.groupBy(*by, "path").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("id"))
        dirs = kept(ids.select(*by, "path", F.lit("tree").alias("kind"), "id", F.lit(False).alias("exec")))
        out = out.unionByName(dirs)
    return out


def flatten(files: DataFrame) -> DataFrame:
    """Files with their place in the order of an export: by path components, not by the whole string."""
    return files.select(*FILE).withColumn("parts", F.split("path", "/"))


def _covering(paths: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of `paths` with the nearest edit at or above them: (path, edit_path, edit_id)."""
    up = paths.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("edit_path"))
    own = edits.select(F.col("path").alias("edit_path"), F.col("id").alias("edit_id"))
    return up.join(own, "edit_path").groupBy("path").agg(F.max_by(F.struct("edit_path", "edit_id"), F.length("edit_path")).alias("e")).select("path", "e.edit_path", "e.edit_id")


def overlay_shadowed(paths: DataFrame, edits: DataFrame) -> DataFrame:
    """Paths that an edit covers, by themselves or by an ancestor."""
    return _covering(paths.select("path").distinct(), edits).select("path")


def overlay_fold(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Files after edits (path, id, exec; id null: removed).

    Files at or under an edit go, and so does a file above one; upserts come. No
    edit may be above another (see prefix_conflicts). Empty directories vanish.
    """
    shadowed = overlay_shadowed(files, edits)
    above = edits.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    gone = shadowed.union(above).distinct()
    return files.select(*FILE).join(gone, "path", "left_anti").unionByName(edits.filter(F.col("id").isNotNull()).select(*FILE))


def prefix_conflicts(candidates: DataFrame, staged: DataFrame) -> DataFrame:
    """(path, other): candidate edits above or below a staged one."""
    below = candidates.select("path", F.explode(ancestors(F.col("path"))).alias("other")).join(staged.select(F.col("path").alias("other")), "other", "left_semi")
    above = staged.select(F.col("path").alias("other"), F.explode(ancestors(F.col("path"))).alias("path")).join(candidates.select("path"), "path", "left_semi")
    return below.select("path", "other").unionByName(above.select("path", "other")).distinct()


def listing(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(parent, name, kind, staged) of each directory after the edits; staged: an upsert lies at or under it."""
    folded = overlay_fold(files, edits)
    fresh = edits.filter(F.col("id").isNotNull()).select("path", F.lit(1).alias("fresh"))
    told = folded.join(fresh, "path", "left").select("path", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    every = told.select(F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("at"), (F.col("at") == F.col("path")).alias("leaf"), "fresh")
    rows = every.filter("at <> ''").groupBy("at").agg(F.max("leaf").alias("leaf"), F.max("fresh").alias("fresh"))
    return rows.select(parent(F.col("at")).alias("parent"), name_of(F.col("at")).alias("name"), F.when(F.col("leaf"), "blob").otherwise("tree").alias("kind"), (F.col("fresh") == 1).alias("staged"))


def resolve(paths: DataFrame, files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, state, id): what each path holds; an edit at it wins, a removed ancestor hides it, a file ancestor makes it invalid."""
    asked = paths.select("path").distinct()
    covered = _covering(asked, edits)
    found = asked.join(covered, "path", "left").join(files.select("path", F.col("id").alias("base_id")), "path", "left")
    here = F.col("edit_path") == F.col("path")
    state = F.when(here & F.col("edit_id").isNotNull(), "blob").when(F.col("edit_path").isNotNull() & F.col("edit_id").isNull(), "absent").when(F.col("edit_path").isNotNull(), "invalid").when(F.col("base_id").isNotNull(), "blob").otherwise("absent")
    return found.select("path", state.alias("state"), F.when(state == "blob", F.coalesce("edit_id", "base_id")).alias("id"))


def new_objects(base: DataFrame, side: DataFrame) -> DataFrame:
    """(id, kind) of entries of `side` whose counterpart at the same path and of the same kind differs or is missing."""
    return side.join(base.select("path", "kind", "id"), ["path", "kind", "id"], "left_anti").select("id", "kind").distinct()


def collisions(names: DataFrame) -> DataFrame:
    """(dir, fold_key, n, names) of siblings that differ only by case or composition.

    Composition has no built-in, so names are normalised in Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(fold_key=[unicodedata.normalize("NFC", n) for n in b["low"]])[["dir", "name", "fold_key"]]

    folded = names.select("dir", "name", F.lower("name").alias("low")).distinct().mapInPandas(run, "dir string, name string, fold_key string")
    grouped = folded.groupBy("dir", "fold_key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return grouped.filter("n > 1")
