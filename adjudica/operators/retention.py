"""What to archive and what to delete, as plans, and the separate, explicit step that carries them out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from adjudica import settings as S


def age_mark(modified: Column, as_of: Column) -> Column:
    """A folder that is gone counts as fresh."""
    return F.coalesce(modified, as_of)


def archive_plan(claims: DataFrame, archived: DataFrame, as_of: Column, days: int | None = None, key: str = "claim", at: str = "modified", settings: S.Settings = S.DEFAULTS) -> DataFrame:
    """claim, moved_to: claims older than ``days`` (nothing or 0: the default), under a new name where one is taken."""
    cutoff = as_of - F.make_dt_interval(F.lit(days or settings.retention_days))
    old = claims.filter(age_mark(F.col(at), as_of) < cutoff)
    taken = archived.select(F.col(key), F.lit(True).alias("_taken")).distinct()
    name = F.when(F.col("_taken"), F.concat(F.col(key), F.lit("_"), F.unix_timestamp(F.col(at).cast("timestamp")).cast("string"))).otherwise(F.col(key))
    return old.join(taken, key, "left").select(key, F.col(at), name.alias("moved_to"))


def delete_plan(archived: DataFrame, as_of: Column, days: int = S.DEFAULTS.archive_days, key: str = "claim", at: str = "modified") -> DataFrame:
    """Archived claims older than ``days``; 0 means 0."""
    return archived.filter(age_mark(F.col(at), as_of) < as_of - F.make_dt_interval(F.lit(days))).select(key, F.col(at))


def kept(archived: DataFrame, deleted: DataFrame, key: str = "claim") -> DataFrame:
    return archived.join(deleted.select(key), key, "left_anti")


def carry_out(plan: DataFrame, claims_root: str, archive_root: str, move: bool, key: str = "claim", dry_run: bool = True) -> DataFrame:
    """Does what a plan says, a folder at a time on the executors: moves it into the archive under its new name, or
    deletes it from there. claim, target and outcome (planned, moved, deleted, missing, failed: why) of each, which is
    the manifest to append. A folder that is gone already is no failure, so a task may run again after a lost
    executor; write the result to a table once rather than evaluate it twice. ``dry_run`` touches nothing."""
    def run(frames):
        from pyarrow import fs

        stores = [fs.FileSystem.from_uri(root) for root in (claims_root, archive_root)]
        for frame in frames:
            rows = []
            for name, target in zip(frame["claim"], frame["target"], strict=True):
                (held, source), (archive, root) = stores
                store, path = (held, f"{source}/{name}") if move else (archive, f"{root}/{target}")
                outcome = "planned"
                if not dry_run:
                    outcome = step(store, path, f"{root}/{target}") if move else step(store, path, None)
                rows.append((name, target, outcome))
            yield pd.DataFrame(rows, columns=["claim", "target", "outcome"])

    def step(store, path: str, target: str | None) -> str:
        from pyarrow import fs

        try:
            if any(part in ("..", "") for part in (target or path).rsplit("/", 1)[-1:]):
                return "failed: odd name"
            if store.get_file_info(path).type != fs.FileType.Directory:
                there = target and store.get_file_info(target).type == fs.FileType.Directory
                return "moved" if there else "missing"
            if target:
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                store.move(path, target)
                return "moved"
            store.delete_dir(path)
            return "deleted"
        except OSError as error:
            return f"failed: {error}"

    target = F.col("moved_to") if "moved_to" in plan.columns else F.col(key)
    return plan.select(F.col(key).alias("claim"), target.alias("target")).mapInPandas(run, "claim string, target string, outcome string")
