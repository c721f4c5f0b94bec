"""Changed files by comparing two scans; the list of a version control system serves as well."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_file, change (added, changed, deleted) of two tables of (source_file, digest)."""
    a = old.select("source_file", F.col("digest").alias("before"))
    b = new.select("source_file", F.col("digest").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("changed")
    return a.join(b, "source_file", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select("source_file", change.alias("change"))


def git_changed(repo: str, before: str, after: str, folder: str = "doc/", timeout: int = 60) -> list[str]:
    """Files below folder that differ between two revisions, without the folder's name. Renames count under both names."""
    done = subprocess.run(["git", "diff", "--name-only", "--no-renames", f"{before}..{after}", "--", folder], cwd=repo, capture_output=True, text=True, timeout=timeout)
    if done.returncode:
        raise RuntimeError(f"git diff failed: {done.stderr.strip()}")
    return [x.removeprefix(folder) for x in done.stdout.splitlines() if x.endswith(".rst")]
